"""Registered queries of the subpackage against their SQL, on the smallest tables and on rows made for it."""

import glob
import os
import random
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_queries import _same

from dotweave.llm import queries, templates

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    _same(queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df())


def docs_of(rng, texts, items):
    return [" ".join((rng.choice(texts), rng.choice(items), rng.choice(texts))) for _ in range(12)]


def test_copies_with_capitals_are_found(spark):
    """Every word with a capital, numbers and punctuation included; a few capitals elsewhere change nothing."""
    item = "a train travels 60 km in two hours and then stops at the old station for lunch"
    title = " ".join(w.capitalize() for w in item.split())
    docs = [(1, f"Some words before. {title}! And behind."), (2, title), (3, item), (4, "Five Words In A Row But No Leak At All"), (5, title.replace("60", "75")), (6, None)]
    a = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(9, item), (9, item), (None, item.upper())], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0) for r in templates.report(a, b).collect())
    assert got == sorted((d, i) for d in (1, 2, 3, 5) for i in (0, 9, 9))
    assert {r["doc_id"] for r in templates.remove(a, b).collect()} == {4, 6}


def test_leaks_of_mixed_texts(spark):
    """Numbers, names, units, punctuation, case and runs of names, in random order, against the SQL."""
    rng = random.Random(5)
    stock = "the of 7 12 km km, Miles five Seven Peter Anna, (Berlin) New York's apples pears; -- run 'quoted' the é Ärger 3rd x42 and gate river".split()
    texts = [" ".join(rng.choice(stock) for _ in range(rng.randrange(3, 40))) for _ in range(60)]
    items = texts[:8]
    docs = texts + [" ".join((rng.choice(texts), rng.choice(items), rng.choice(texts))) for _ in range(60)] + [t.lower() for t in items] + [t.upper() for t in items] + [" ".join(w[:1].upper() + w[1:] for w in t.split()) for t in items + docs_of(rng, texts, items)] + ["", None, texts[0], "  \n "]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    documents, benchmark = a.toPandas(), b.toPandas()  # noqa: F841  read by name
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    found = templates.report(a, b).toPandas()
    assert len(found) > 60
    _same(found, con.sql(queries.ORACLES["op7_benchmark_leaks"]).df())


def test_windows_are_compiled(spark):
    """Spark's compiled loop makes the windows, of one length or of all; one text of many words is no row a word that holds them all."""
    import time

    text = " ".join(f"word{i % 9973}x" for i in range(200_000))
    df = templates._tokens(spark.createDataFrame([(1, text), (2, "a b c d e"), (3, ""), (4, None)], "key bigint, t string"), "t")
    for lengths in ([8], [5, 6, 7, 8]):
        out = templates._windows(df, lengths, ["key"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Generate ") == sum(line.split("Generate ")[0].rstrip().endswith(")") for line in plan.splitlines() if "Generate " in line) > 0, plan
        begin = time.time()
        assert {r["key"]: r["n"] for r in out.groupBy("key").agg(F.count("h").alias("n")).collect()} == {1: sum(200_001 - k for k in lengths)} | ({2: 1} if 5 in lengths else {})
        assert time.time() - begin < 60
        # The hash of a window is the benchmark's.
        items = templates._benchmark(spark.createDataFrame([(1, "zz yy xx ww vv uu tt ss rr")], "id bigint, t string"), "id", "t").select("h")
        same = templates._windows(templates._tokens(spark.createDataFrame([(1, "zz yy xx ww vv uu tt ss rr")], "key bigint, t string"), "t"), lengths, ["key"])
        assert {r["h"] for r in items.collect()} <= {r["h"] for r in same.collect()}


def test_marks_are_those_of_plain_patterns(spark):
    """Numbers, names, units and titles by words' first letters and spaces, against the patterns written out."""
    rng = random.Random(11)
    stock = " ".join((templates.NUMBERS, templates.FUNCTION, templates.UNITS)).split() + "7 x42 3rd km2 ten's Peter New Ärger é McX Sixty tenor ones onE NINE sixteenth ß Ǆa ٣ -- (Of) \u00a0 \u2028 \t".split(" ")
    cased = lambda w: rng.choice((w, w, w.capitalize(), w.upper()))
    texts = [rng.choice(("", " ", "\n")) + rng.choice((" ", " ", "\n", "  ")).join(cased(rng.choice(stock)) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", templates._words(F.col("t")))
    either = lambda names: "(?i:" + "|".join(dict.fromkeys(names.split())) + ")(?= |$)"
    out = F.regexp_replace("w", f"(?<![^ ])(?:[^ 0-9]*+[0-9][^ ]*+|{either(templates.NUMBERS)})", "<n>")
    out = F.regexp_replace(out, rf"(?<![^ ])(?=\p{{Lu}}\p{{Ll}})(?!{either(templates.FUNCTION)})[^ ]++", "<name>")
    plain = F.lower(F.regexp_replace(out, f"<n> {either(templates.UNITS)}", "<n> <u>"))
    got = df.select(templates._marked(F.col("w")).alias("a"), plain.alias("b"), templates._titled(F.col("t")).alias("c"), F.col("t").rlike(templates.TITLES).alias("d")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and [r["c"] for r in got] == [r["d"] for r in got]
    assert {r["c"] for r in got} == {True, False} and any("<u>" in r["a"] for r in got)


def test_long_items_cost_in_proportion(spark):
    import time

    rng = random.Random(6)
    stock = ["Peter", "12", "km"] + ["".join(rng.choices("abcdefgh", k=7)) for _ in range(400)]
    long = [(i, " ".join(rng.choice(stock) for _ in range(1000))) for i in range(20)]
    items = spark.createDataFrame(long, "item_id bigint, text string")
    begin = time.time()
    assert templates._benchmark(items, "item_id", "text").select("item").distinct().count() == 20
    assert time.time() - begin < 30
