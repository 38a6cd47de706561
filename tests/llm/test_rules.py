"""Native quality rules, URL rules, chat formatting and licence scans."""

import random
import re

import duckdb
import numpy as np
from helpers import LETTERS, SPACED, frame, words

from ridgemark.llm import chat, licenses, rules, urls


def base(text):
    w = SPACED.findall(text or "")
    windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {
        x for x, n in zip(*np.unique([" ".join(x) for x in windows], return_counts=True)) if n > 1}
    covered = {k + j for k, x in enumerate(windows) if x in twice or " ".join(x) in twice for j in range(8)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_counts(docs, texts, nothing):
    got = {r["doc_id"]: tuple(r)[1:] for r in rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    for i, t in enumerate(texts):
        want = base(t)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i][:6] == (*want, failed), i
        assert not (failed and got[i][6])
    assert rules.quality_rules(nothing).count() == 0


def _robust(x):
    """The estimate in plain loops over whole documents: every start, all steps, least determinant."""
    floors = np.array(list(rules.FEATURES.values()))

    def quantile(v, q):
        return np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]

    def factor(cov):
        low = np.zeros_like(cov)
        for i in range(len(cov)):
            for j in range(i + 1):
                rest = cov[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(rest, floors[i] ** 2)) if i == j else rest / low[j, j]
        return low

    def squared(centre, low):
        return (np.linalg.solve(low, (x - centre).T) ** 2).sum(0)

    def moments(part, consistency):
        return part.mean(0), factor(consistency * np.cov(part.T, bias=True).reshape(len(floors), -1))

    centre = np.array([quantile(c, 0.5) for c in x.T])
    spread = np.array([quantile(abs(c - m), 0.5) for c, m in zip(x.T, centre)])
    found = []
    for start in [(centre, factor(np.diag((1.4826 * spread) ** 2))), moments(x, 1.0)]:
        for _ in range(rules.MAX_STEPS):
            steps = np.floor(np.log2(1 + squared(*start)) * rules.FINE)
            after = moments(x[steps <= quantile(steps, rules.SUBSET)], rules.CONSISTENCY)
            still = np.allclose(after[0], start[0], atol=1e-12) and np.allclose(after[1], start[1], atol=1e-12)
            start = after
            if still:
                break
        found.append(start)
    best = min(found, key=lambda e: np.log(np.diag(e[1])).sum())
    return squared(*best)


def test_outliers_against_numpy(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(rules, "DRAWS", 0)               # drawn starts depend on Spark's hash
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = rules.features(rules.base_counts(docs)).filter("not base_failed").toPandas()
    got = rules.quality_rules(docs).filter("not base_failed").toPandas().set_index("doc_id")
    for _, group in rows.groupby(["lang", "source"], dropna=False):
        want = _robust(group[list(rules.FEATURES)].to_numpy())
        np.testing.assert_allclose(got.loc[group["doc_id"], "distance"], want, rtol=1e-6, atol=1e-9)
    assert not got[got["distance"] > rules.BOUND]["kept"].any()


def test_outliers_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, many = ({tuple(r) for r in rules.quality_rules(docs.repartition(n)).collect()} for n in (1, 50))
    assert one == many


def test_more_starts_find_a_smaller_determinant(spark):
    """Vectors of two clusters: the estimate is never larger than that of the medians alone."""
    r = np.random.default_rng(11)
    rows = [(int(i), "en", "s", *(float(round(v * rules.SCALE) / rules.SCALE) for v in r.normal(4.0 * (i % 5 > 2), 0.9 + i % 2, 4)))
            for i in range(400)]
    found = rules.points(spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(
        f"{c} double" for c in rules.FEATURES)))
    first = rules.starts(found)
    assert {r["start"] for r in first.collect()} == {0, 1, 2, 3}
    alone = rules.settled(found, first.filter("start = 0"))
    full = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} double" for c in rules.FEATURES))
    assert rules.estimates(full).first()["size"] <= alone.first()["size"] + 1e-12


def test_every_statistic_can_reject_alone(spark):
    prose = [" ".join(f"word{(i * j) % 97}x{j}" for j in range(1, 60)) for i in range(1, 60)]
    short = [f"line{k}" for k in range(12)]
    lines = "\n".join([*short, *reversed(short), " ".join(prose[0].split())])
    eight = " ".join(f"again{k}" for k in range(8))
    again = " ".join([eight, *prose[3].split()[:25], eight, *prose[3].split()[25:55]])
    for odd, name in ((lines, "n_dup_lines"), (again, "n_repeat_words")):
        got = {r["doc_id"]: r for r in rules.quality_rules(frame(spark, [*prose, *prose, odd]).drop("source").selectExpr(
            "*", "'s' as source")).collect()}
        last = got.pop(2 * len(prose))
        assert last[name] > 0 and not last["base_failed"] and not last["kept"], name
        assert all(r["kept"] for r in got.values())


def test_outliers_of_a_group(spark):
    prose = [" ".join(f"word{(i * j) % 97}" for j in range(1, 60)) for i in range(1, 60)]
    junk = " ".join(f"word{j}###" for j in range(60))
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(frame(spark, [*prose, junk])).collect()}
    assert not got[len(prose)] and all(got[i] for i in range(len(prose)))


def test_url_rules(spark, sf_dir, monkeypatch):
    cases = [None, "", "no scheme", "http://example.com/en/x", "http://WWW.Example.com/en/x", "http://a.www.example.com/en/",
             "http://example.com", "http://x.com/", "com://com/", "http://notexample.com/en/x", "http://a.net/fr/1?x#y",
             "http://a.net?/fr/", "http://m.x.org/de/1.html", "http://m.x.org/de/1.html?q", "http://docs.a.org/login/help/",
             "http://a.org/login/", "http://ads.a.org", "http://é.net/es/\n1", "http://x.example.com/en/#://b.net/es/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id long, url string, host string, rule string")
    pages = pages.unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(
        "page_id + 100 as page_id", "url", "'h' as host", "'r' as rule"))
    table = urls.NAMED + urls.PATTERNS
    got = sorted(map(tuple, urls.filter_urls(pages, table).collect()))
    arrow = pages.select("page_id", "url").toArrow()
    db = duckdb.connect()
    db.register("pages", arrow)
    assert got == sorted(db.sql(urls.oracle(table)).fetchall())
    by = {r[0]: r for r in got}
    assert by[3][3:5] == ("example.com/en/", "block") and by[5][3:5] == ("www.example.com/en/", "allow")
    assert by[6][3] is None and by[0][1:5] == ("", "", None, "allow") and by[15][4] == "block" and by[14][4] == "allow"
    assert urls.filter_urls(pages.limit(0), table).count() == 0
    # Rules without a literal token, and a list too long for the plan.
    table += [urls.Rule("/de*l^", "block"), urls.Rule("*x", "allow"), urls.Rule("||nothing.like.this^", "block")]
    want = sorted(db.sql(urls.oracle(table)).fetchall())
    assert sorted(map(tuple, urls.filter_urls(pages, table).collect())) == want and any("*x" in r[5] for r in want)
    monkeypatch.setattr(urls, "INLINE", 3)
    for size in (urls.BROADCAST_BYTES, 0):
        monkeypatch.setattr(urls, "BROADCAST_BYTES", size)
        assert sorted(map(tuple, urls.filter_urls(pages, table).collect())) == want
    assert urls.filter_urls(pages.limit(0), table).count() == 0
    assert {r[4] for r in urls.filter_urls(pages, []).collect()} == {"allow"}


def test_chat_formatting(spark):
    def conv(*turns):
        return [{"role": r, "text": t} for r, t in turns]

    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, conv(u, a), conv(u, b)), (2, conv(u, a), conv(u, a)), (3, conv(a), conv(u, a)), (4, None, conv(u)),
            (5, conv(u, a, u), conv(u, a)), (6, conv((None, None)), conv((None, None), b)), (7, [], [])]
    pairs = spark.createDataFrame(rows, f"id long, chosen {chat.TURNS}, rejected {chat.TURNS}")
    got = {r["id"]: r for r in chat.format_preferences(pairs).collect()}
    assert [got[i]["prompt_turns"] for i in range(1, 8)] == [1, 2, 0, 0, 2, 1, 0]
    assert got[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert [(p["text"], p["mask"]) for p in got[1]["rejected_completion"]] == [("<|im_start|>assistant\n", 0), ("no<|im_end|>\n", 1)]
    assert got[2]["chosen_completion"] == [] and [p["mask"] for p in got[5]["chosen_completion"]] == [0, 0]


def test_chat_pairs_against_sql(spark):
    rows = [(c, t, r, x) for c in range(9) for t, (r, x) in enumerate(
        [("system", "s"), ("user", f"q{c // 4}"), ("assistant", f"a{c}"), ("user", None), ("assistant", "é")][:1 + c % 5])]
    rows += [(c, 0, "user", f"n{c // 2}") for c in (-4, -3, 1 << 60, (1 << 60) + 1)] + [(3, 9, "assistant", "late"), (None, 0, "user", "x"), (7, None, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    db = duckdb.connect()
    db.register("conversations", turns.toArrow())
    result = chat.digest(turns)
    want = db.sql(f"select {', '.join(result.columns)} from ({chat.oracle()})").fetchall()
    assert sorted(map(tuple, result.collect())) == sorted(want)
    assert chat.digest(turns.limit(0)).count() == 0


def test_license_scans(spark, nothing):
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = ["Licensed under CC BY-NC 4.0.", "all rights reserved. All  Rights\nReserved", "general public general public license", "ccby cc",
             "Released under the MIT license.", full, full.replace("any person", "some people"), full.replace("granted", "given"),
             "cc", "", None, "by cc by cc by", "This work is licensed under the GNU General Public License, version 3.", "é cc É by"]
    got = {r["doc_id"]: r for r in licenses.digest(frame(spark, texts)).collect()}
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    for i, t in enumerate(texts):
        w = words(t, LETTERS)
        places = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k:k + len(p)] == p]
        starts = [k for k, _ in places]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert [got[i]["labels"] for i in (0, 4, 5, 6, 7, 12)] == ["cc-by,cc-by-nc", "mit", "mit", "mit", "", "gpl,gpl-3.0"]
    assert got[9]["score"] == 0 and got[5]["score"] == 1 and licenses.digest(nothing).count() == 0
    assert re.fullmatch(r"[a-z0-9.,-]*", got[0]["labels"])


def test_templates_against_all_places(spark):
    """Labels and shares by trying every template at every place; edited templates keep their phrase."""
    r = random.Random(4)
    texts = []
    for t in licenses.TEMPLATES:
        w, p = t.text.split(), t.phrase.split()
        k = next(i for i in range(len(w)) if w[i:i + len(p)] == p)
        loose = [i for i in range(len(w)) if not k <= i < k + len(p)]
        for n in range(len(loose) + 1):
            edited = list(w)
            for i in r.sample(loose, n):
                edited[i] = r.choice(["other", "words", w[0]])
            texts.append(" ".join(["some", "prose", *edited, *edited[:r.randint(0, len(w))], "end"]))
    mit = next(t for t in licenses.TEMPLATES if t.text.startswith("permission is hereby"))
    rare = mit.text.replace("person", "one").replace("associated", "other").replace("obtaining", "getting")
    texts += [rare, None, "", "permission " * 50]
    docs = frame(spark, texts)
    frequency, n_docs = licenses.frequencies(docs, licenses.BASE + licenses.TEMPLATES)
    sets = [set(words(t, LETTERS)) for t in texts]
    got = {d["doc_id"]: sorted((m["label"], m["start"], round(m["share"], 9)) for m in d["matches"] if not m["base"])
           for d in licenses.scan(docs, licenses.BASE + licenses.TEMPLATES).collect()}
    for i, t in enumerate(texts):
        own, want = words(t, LETTERS), []
        for template in licenses.TEMPLATES:
            w, p = template.text.split(), template.phrase.split()
            k = next(j for j in range(len(w)) if w[j:j + len(p)] == p)
            weight = [max(np.log((n_docs + 1) / (sum(x in s for s in sets) + 0.5)), 1e-9) for x in w]
            for start in range(-len(w), len(own)):
                at = [own[start + j] if 0 <= start + j < len(own) else None for j in range(len(w))]
                share = sum(v for v, x, y in zip(weight, at, w) if x == y) / sum(weight)
                if at[k:k + len(p)] == p and share >= licenses.SHARE:
                    want.append((template.label, start, round(share, 9)))
        assert got[i] == sorted(want), t
    assert any(m[2] < 1 for found in got.values() for m in found)
