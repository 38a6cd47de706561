"""DuckDB statements that answer the registered queries on the same tables."""

from oracles import cylinder, text, vectors

SQL = {**vectors.SQL, **cylinder.SQL, **text.SQL}
