"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a list of tokens. Numbers (also in words), names (capitalised words
that are no function words; a run of them is one) and units (a unit word behind a
number) become typed placeholders; other words are lower-cased and stripped of
punctuation. What a word becomes does not depend on the sentence around it. Windows
of the templates of a benchmark are joined by hash with those of the documents, so a
question with other numbers or names still meets its source. What stands in a
slot of the question must then be replaced alike everywhere: one value of the
item, one value of the document. Every occurrence of a window counts: slots are
checked over the first ones of the whole document, along each unbroken copy and in
bands of neighbouring ones, and the best of these is reported. Windows without slots,
or with the item's own values in them, need no such check.

Items are read as they are and in lower case, so copies in lower or upper case are
found too. A document is read as it is, and if it holds five words in a row that begin
with capitals, in lower case too, so copies that give every word a capital are found.
A document leaks an item if enough of the item's windows are found in it: half of them,
or as many as thirteen words in a row give; where both readings show a leak, the first
one is reported. Not found: re-parameterised copies whose new names have no capital.

Edge cases: null and empty texts have no windows; whole texts are read, however long;
an item shorter than a window is one window of its own length, matched against windows
of that length, if it has at least ``SHORTEST`` words; windows with fewer than
``LITERAL`` plain words are no evidence; repeated items and repeated rows are found
each, equal texts are examined together; ids may be null; an empty table of either
kind leaks nothing; only id and text are read in ``report``, and ``remove`` passes
other columns through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotweave.llm.common import cut_lineage, deal

WINDOW = 8
SHORTEST = 5
#: Windows that a leak needs at most: those of thirteen words in a row.
ENOUGH = 6
SHARE = 0.5
LITERAL = 4
#: A benchmark whose windows fill less than this is sent to every executor; a larger one is joined by a shuffle.
SMALL_BYTES = 64 << 20

# Unit words.
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh"
NUMBER, NAME, UNIT = "<n>", "<name>", "<u>"

# Words that are no names though they are capitalised, and numbers in words.
FUNCTION = "a an the this that these those some any each every all both no not if when while after before because since until although though as at by for from in into of on onto over to under with without within about between during through and or but nor so yet then than there here he she it they we you i his her its their our your my him them us me who whom whose what which where why how is are was were be been being am do does did has have had can could will would shall should may might must let suppose given find calculate determine compute solve show prove answer question problem example solution note explain describe consider how many much more most"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
#: Five words in a row that begin with a capital or a digit (all in capitals they need no second reading).
TITLES = r"(?:^|\s)(?:[^\s\p{L}\p{N}]*(?:\p{Lu}(?:\p{Ll}\S*)?|\p{N}\S*)\s+){4}[^\s\p{L}\p{N}]*(?:\p{Lu}\p{Ll}|\p{N})"
#: The same of a text behind a space: spaces that no such word can follow are passed at a look.
BEHIND_SPACE = TITLES.replace(r"(?:^|\s)", r"\s(?![a-z\s])", 1)
#: How items are read: as they are, and in lower case.
READINGS = 2
SLOTS = f"('{NUMBER}', '{NAME}', '{UNIT}')"


def _words(text: Column) -> Column:
    """Words without punctuation, one space between them."""
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}\s\p{Z}]+", "")
    return F.trim(F.regexp_replace(bare, r"[\s\p{Z}]+", " "))


def _either(names: str) -> str:
    """One of the words, whole and in any case; their first letters are told apart first."""
    by: dict[str, list[str]] = {}
    for name in dict.fromkeys(names.split()):
        by.setdefault(name[0], []).append(name[1:])
    return "(?i:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")(?= |$)"


def _titled(text: Column) -> Column:
    return F.concat(F.lit(" "), text).rlike(BEHIND_SPACE)


def _marked(words: Column) -> Column:
    """The same words in lower case, with placeholders for numbers, names and units; all in passes over the whole text.

    A space is put before the text, so that every word is found by the space before it.
    """
    out = F.regexp_replace(F.concat(F.lit(" "), words), f" (?:{_either(NUMBERS)}|[^ 0-9]*+[0-9][^ ]*+)", f" {NUMBER}")
    out = F.regexp_replace(out, rf" (?=\p{{Lu}}\p{{Ll}})(?!{_either(FUNCTION)})[^ ]++", f" {NAME}")
    out = F.regexp_replace(out, f"{NUMBER} {_either(UNITS)}", f"{NUMBER} {UNIT}")
    return F.lower(F.substring(out, 2, 2**31 - 1))


def _tokens(df: DataFrame, text: str) -> DataFrame:
    """Adds ``tokens``; a run of names is one."""
    return df.withColumn("tokens", F.split(F.regexp_replace(_marked(_words(F.col(text))), f"{NAME}(?: {NAME})+", NAME), " "))


def _filled(df: DataFrame, text: str) -> DataFrame:
    """Adds ``tokens`` and ``plain``, the words behind each of them."""
    words = df.withColumn("w", _words(F.col(text))).withColumn("m", F.split(_marked(F.col("w")), " ")).withColumn("w", F.split(F.lower("w"), " "))
    later = f"(x = '{NAME}' AND i > 0 AND m[i - 1] = '{NAME}')"
    runs = f"split(substring(array_join(transform(m, (x, i) -> concat(CASE WHEN {later} THEN '_' ELSE ' ' END, w[i])), ''), 2), ' ')"
    return words.withColumns({"tokens": F.expr(f"filter(m, (x, i) -> NOT {later})"), "plain": F.expr(runs)}).drop("w", "m")


def _hash(k: int) -> str:
    """The hash of the ``k`` tokens from ``at`` on."""
    return f"xxhash64({k}, {', '.join(f'get(hs, at + {j})' for j in range(k))})"


def _windows(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """One row a window of each length: ``keep``, its place and the hash of its length and tokens. Words are hashed once each.

    Places become rows before windows are hashed, so that Spark compiles hashes and the
    join behind them into one loop over a text's words; the words don't leave it.
    """
    hashed = df.select(*keep, F.expr("transform(tokens, t -> xxhash64(t))").alias("hs"))
    least = min(lengths)
    out = hashed.select(*keep, "hs", F.explode(F.expr(f"CASE WHEN size(hs) >= {least} THEN sequence(0, size(hs) - {least}) END")).alias("at"))
    if len(lengths) == 1:
        return out.select(*keep, "at", F.expr(_hash(least)).alias("h"))
    out = out.select("*", F.explode(F.array(*[F.lit(k) for k in lengths])).alias("k")).where("at + k <= size(hs)")
    return out.select(*keep, "at", F.expr(f"CASE k {' '.join(f'WHEN {k} THEN {_hash(k)}' for k in lengths)} END").alias("h"))


def _benchmark(items: DataFrame, id: str, text: str) -> DataFrame:
    """Windows of the items: item, row (item and reading), n (windows of it), at, k, h and what fills each slot; without those that are mostly slots.

    Items are dealt over all tasks, and their tokens are settled before windows are
    made of them, so a benchmark of long items costs time in proportion.
    """
    spark = items.sparkSession
    own = items.select(F.col(f"`{id}`").alias("item"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    own = cut_lineage(own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row"))
    low = F.lower("t")
    read = own.select("item", (F.col("row") * READINGS).alias("row"), "t").union(own.where(F.col("t") != low).select("item", F.col("row") * READINGS + 1, low))
    own = cut_lineage(_filled(read, "t").where(F.size("tokens") >= SHORTEST).withColumn("hs", F.expr("transform(tokens, t -> xxhash64(t))")))
    own = own.select("*", F.least(F.size("tokens"), F.lit(WINDOW)).alias("k")).withColumn("at", F.explode(F.expr("sequence(0, size(tokens) - k)")))
    out = own.withColumn("slot", F.expr(f"transform(slice(tokens, at + 1, k), t -> t IN {SLOTS})")).withColumn("slots", F.expr("size(filter(slot, s -> s))")).where(F.col("k") - F.col("slots") >= LITERAL)
    hashes = F.coalesce(*[F.when(F.col("k") == k, F.expr(_hash(k))) for k in range(SHORTEST, WINDOW + 1)])
    out = cut_lineage(out.select("item", "row", "k", "at", hashes.alias("h"), F.expr("slice(plain, at + 1, k)").alias("plain"), "slot", "slots"))
    return out.join(out.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("n")), "row")


def _matches(df: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str) -> DataFrame:
    """One row for each (text key, item) that share a window: windows found, of how many, slots and slots filled in two ways, where most windows are found."""
    bench = cut_lineage(_benchmark(items, item_id, item_text))
    lengths = [r[0] for r in bench.select("k").distinct().orderBy("k").collect()] or [WINDOW]  # at most WINDOW - SHORTEST + 1 numbers
    rows = bench.count()
    send = F.broadcast if rows * 400 <= SMALL_BYTES else (lambda x: x)
    source = df.select(F.unhex(F.md5("t")).alias("key"), "t")
    windows = _windows(_tokens(source, "t"), lengths, ["key"])
    thin = bench.select(F.col("h").alias("bh"), "item", "row", "n", F.col("at").alias("iat"), "slots")
    met = windows.join(send(thin), F.col("h") == F.col("bh"))  # the length is in the hash
    met = cut_lineage(met.select("key", "item", "row", "n", "iat", "slots", "at").distinct())

    # What fills the slots, for the texts that have any: read again, as they are few; of equal texts each task gives one.
    slotted = met.where("slots > 0")
    keys = slotted.select("key").distinct()
    one = lambda texts: texts.groupBy("key").agg(F.any_value("t").alias("t"))
    filled = one(source.join(F.broadcast(keys), "key", "left_semi")) if keys.count() * 64 <= SMALL_BYTES else one(source).join(keys, "key", "left_semi")
    filled = _filled(filled, "t").select("key", "plain")
    ours = bench.where("slots > 0").select("row", F.col("at").alias("iat"), F.col("plain").alias("iplain"), "slot", "k")
    fills = "transform(filter(arrays_zip(iplain, slot, p), x -> x.slot), x -> struct(x.iplain AS theirs, x.p AS ours))"
    read = slotted.join(filled, "key").join(ours, ["row", "iat"]).withColumn("p", F.expr("slice(plain, at + 1, k)")).select("key", "item", "row", "n", "iat", "at", F.expr(fills).alias("fills"))
    bare = met.where("slots = 0").select("key", "item", "row", "n", "iat", "at", F.expr("CAST(array() AS array<struct<theirs: string, ours: string>>)").alias("fills"))
    own = F.expr("forall(fills, x -> x.theirs = x.ours)")
    # The whole text, the line of an unbroken copy, and two rows of bands that hold copies with words put in or left out.
    line, band = "CAST(at - iat AS bigint)", f"2 * (n + {WINDOW})"
    scopes = f"array(struct(0 AS scope, 0L AS place), struct(1 AS scope, {line} AS place), struct(2 AS scope, floor({line} / ({band})) AS place), struct(3 AS scope, floor(({line} + n + {WINDOW}) / ({band})) AS place))"
    each = read.unionByName(bare).select("*", own.alias("own"), F.explode(F.expr(scopes)).alias("s")).select("key", "item", "row", "n", "iat", "at", "fills", "own", "s.*")
    each = each.groupBy("key", "item", "row", "n", "scope", "place", "iat").agg(F.min_by("fills", "at").alias("fills"), F.bool_or("own").alias("own"))
    each = cut_lineage(each)
    pairs = each.select("key", "row", "scope", "place", F.explode("fills").alias("x"))
    values = pairs.groupBy("key", "row", "scope", "place", F.col("x.theirs").alias("v")).agg((F.min("x.ours") != F.max("x.ours")).alias("two"))
    checked = values.groupBy("key", "row", "scope", "place").agg(F.count(F.lit(1)).alias("slot_values"), F.count_if("two").alias("conflicts"))

    found = each.groupBy("key", "item", "row", "n", "scope", "place").agg(F.count(F.lit(1)).alias("found"), F.count_if("own").alias("literal"))
    found = found.join(checked, ["key", "row", "scope", "place"], "left").fillna(0, ["slot_values", "conflicts"])
    found = found.withColumn("windows", F.when(F.col("conflicts") == 0, F.col("found")).otherwise(F.col("literal")))
    best = F.max(F.struct("windows", (-F.col("scope")).alias("s"), (-F.col("place")).alias("p"), "slot_values", "conflicts")).alias("b")
    found = found.groupBy("key", "item", "row", "n").agg(best).select("key", "item", "row", "n", "b.*")
    # Of the readings the first that shows a leak.
    first = F.max(F.struct((F.col("windows") >= _need()).alias("leak"), (-(F.col("row") % READINGS)).alias("reading"), "n", "windows", "slot_values", "conflicts")).alias("b")
    return found.groupBy("key", "item", F.floor(F.col("row") / READINGS).alias("row")).agg(first).select("key", "item", "row", "b.n", "b.windows", "b.slot_values", "b.conflicts")


def _need():
    return F.greatest(F.lit(1), F.least(F.lit(ENOUGH), F.ceil(F.col("n") * SHARE)))


def leaks(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, windows, item_windows, slot_values, conflicts) for every different text and item that it leaks."""
    source = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    low = F.lower("t")
    titled = _titled(F.col("t")) & (F.col("t") != low)
    # The lower case of a text is a text of its own; its leaks are those of all texts that it is the lower case of.
    read = source.select(F.explode(F.when(titled, F.array("t", low)).otherwise(F.array("t"))).alias("t"))
    figures = ["n", "windows", "slot_values", "conflicts"]
    found = cut_lineage(_matches(read, items, text, item_id, item_text).where(F.col("windows") >= _need()).select("key", "item", "row", *figures))
    second = source.where(titled).select(F.unhex(F.md5("t")).alias("key"), F.unhex(F.md5(low)).alias("low")).distinct()
    again = found.withColumnRenamed("key", "low")
    again = second.join(F.broadcast(again) if found.count() * 200 <= SMALL_BYTES // 4 else again, "low").drop("low")
    both = found.withColumn("reading", F.lit(0)).unionByName(again.withColumn("reading", F.lit(1)))
    first = both.groupBy("key", "item", "row").agg(F.min(F.struct("reading", *figures)).alias("b"))
    return first.select("key", "item", "b.windows", F.col("b.n").cast("bigint").alias("item_windows"), "b.slot_values", "b.conflicts")


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def report(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each row of ``df`` and item that it leaks; a leaking text that many rows hold is dealt to many parts."""
    found = cut_lineage(leaks(df, items, text, item_id).withColumnsRenamed({"key": "__key", "item": item_id}))
    rows = df.select(F.col(f"`{id}`"), _key(text).alias("__key"))
    if found.count() * 200 <= SMALL_BYTES // 4:
        return rows.join(F.broadcast(found), "__key").drop("__key")
    copies = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("copies"))
    left, right = deal(rows, cut_lineage(found.join(copies, "__key")), "__key", "copies", F.xxhash64(F.col(f"`{id}`")))
    return left.join(right, ["__key", "__part"]).drop("__key", "__part", "copies")


def remove(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``df``, with its columns, that leak no item."""
    gone = cut_lineage(leaks(df, items, text, item_id).select("key").distinct())
    if gone.count() * 64 <= SMALL_BYTES // 4:
        gone = F.broadcast(gone)
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _key(text).alias("key"))
    return row.join(gone, "key", "left_anti").select("row.*")
