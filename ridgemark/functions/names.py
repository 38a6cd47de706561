"""File-name expressions: base names, database type, genuine pairs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Database types and the path patterns that tell them, in the
# order in which they are tried.
TYPE_PATTERNS = (
    ("nist", r"\/[f|s|F|S][0-9]*(\.xyt)?$"),
    ("sfinge", r"\/(Sfinge)?[A-Z][a-z]+[0-9]+_[0-9]+(\.xyt)?$"),
    ("fvc", r"\/[0-9]+_[0-9]+(\.xyt)?$"),
    ("mcyt", r"\/(pb|dp)+_[0-9]{4}_[0-9]_[0-9]+(\.xyt)?$"),
    ("casiav5", r"\/[0-9]{3}\/[LR]\/[0-9]{3}_[LR][0-3]_[0-9]+(\.xyt)?$"),
    ("fingerpass", r"\/[A-Za-z0-9]+_[0-9]{4}_[0-9]{2}(\.xyt)?$"),
    ("spain", r"\/[0-9]{5}[A-Z]{4}(RE|V[1-3])[0-9]{3}(_1[12])?(\.xyt)?$"),
)


def strip_directory(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.xyt$", "")


def base_name(path: Column) -> Column:
    return strip_extension(strip_directory(path))


def db_type(path: Column) -> Column:
    found = F
    for name, pattern in TYPE_PATTERNS:
        found = found.when(path.rlike(pattern), name)
    return found.otherwise("unknown")


def genuine(f1: Column, f2: Column, db="unknown") -> Column:
    """Whether two file names belong to one finger.

    ``db`` names the rule; "unknown" takes the type both names agree on.
    The test is not symmetric: the first name (the probe) is searched for in
    the second.
    """
    detected = F.when(db_type(f1) == db_type(f2), db_type(f1)).otherwise("unknown")
    rule = db if isinstance(db, Column) else F.lit(db)
    rule = F.when(rule == "unknown", detected).otherwise(rule)

    def finger_prefix(path):
        return F.regexp_extract(strip_directory(path), r"^(.*_)", 1)

    def tokens(path):
        bare = F.regexp_replace(strip_directory(path), r"\.[^.]*$", "")
        return F.filter(F.split(bare, "_"), lambda t: t != "")

    def same_token(i):
        return F.get(tokens(f1), F.lit(i)) == F.get(tokens(f2), F.lit(i))

    def neutral(path):
        return F.translate(path, "fFsS|", "LLLLL")

    sfinge = f2.contains(F.regexp_replace(finger_prefix(f1), r"^[^.]*\.", ""))
    first7 = F.substring(strip_directory(f1), 1, 7) == F.substring(strip_directory(f2), 1, 7)
    verdict = (F.when(rule == "nist", neutral(f1) == neutral(f2))
               .when(rule.isin("sfinge", "fvc"), sfinge)
               .when(rule == "mcyt", same_token(1) & same_token(2))
               .when(rule == "fingerpass", same_token(1))
               .when(rule == "casiav5", f2.contains(finger_prefix(f1)))
               .when(rule == "spain", first7))
    return F.coalesce(verdict, F.lit(False))
