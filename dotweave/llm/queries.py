"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dotweave.llm import alignment, bagminhash, isomedia, languages, licences, lineblocks, merkle, mixing, quality, shards, templates, tokencount, toxicity
from dotweave.llm.common import cut_lineage, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sequences(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(table(spark, sf_dir, "documents"), grow=False)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineblocks.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.store(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), ["doc_id"], tokenizer_path("byte_bpe_50k.json"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def training_part(id: str = "i") -> Column:
    """The rows that labels may be learned from."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5 != 0


def document_path() -> Column:
    """Documents have no path; their language stands for one below the source."""
    return F.concat_ws("/", F.col("source"), F.col("lang"))


def document_file() -> Column:
    """Documents lie in source/language/hundreds of ids."""
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.expr("doc_id div 100").cast("string"), F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory has a licence if a document in it says nothing else."""
    scanned = cut_lineage(licences.scan(table(spark, sf_dir, "documents"), document_file(), keep=["doc_id"]))
    return licences.inherit(scanned, licences.licence_files(scanned, "doc_id"))


def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), part=training_part())
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.withColumn("held_out", ~F.coalesce(training_part("doc_id"), F.lit(True)))


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "source", document_path(), part=training_part())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the rows is tampered with: one is added to n_chars before the leaf is checked."""
    docs = table(spark, sf_dir, "documents")
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col("n_chars") + 1 if k == 3 else c for k, c in enumerate(named)]
    leaves = docs.select(merkle.group_key(F.col("lang")).alias("group"), "doc_id", merkle.leaf(named).alias("digest"), F.when(tampered, merkle.leaf(changed)).alias("tampered"))
    proofs = merkle.manifest(leaves, ["doc_id"])
    checked = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), checked.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score(table(spark, sf_dir, "documents"), ["doc_id"], tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = languages.fit(docs, ~held)
    return languages.predict(docs, model, ["doc_id"]).withColumn("held_out", F.coalesce(held, F.lit(False)))


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_mixed_sources, op3_near_duplicates, op4_html_main_text, op5_iso_media, op6_token_counts, op7_benchmark_leaks, op8_licences, op9_toxicity_scores, op10_quality_scores, op11_merkle_manifest, op12_token_alignment, op13_language_mixtures)}

#: Exact weighted Jaccard of all pairs that share a shingle, then components; equal texts are one.
NEAR_DUPLICATES = """
WITH RECURSIVE texts AS (
  SELECT md5(coalesce(text, '')) AS k, min(doc_id) AS id, count(*) AS copies, any_value(coalesce(text, '')) AS t FROM documents GROUP BY 1
), words AS (
  SELECT k, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM texts
), grams AS (
  SELECT k, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words WHERE len(w) > 0
), bags AS (SELECT k, g, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT k, sum(c) AS n FROM bags GROUP BY k),
shared AS (SELECT x.k AS a, y.k AS b, sum(least(x.c, y.c)) AS s FROM bags x JOIN bags y ON x.g = y.g AND x.k < y.k GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN totals p ON p.k = a JOIN totals q ON q.k = b WHERE s >= 0.8 * (p.n + q.n - s)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(k, root) AS (SELECT k, k FROM texts UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.k),
roots AS (SELECT k, min(root) AS root FROM reach GROUP BY k),
sizes AS (SELECT root, min(id) AS class_id, CAST(sum(copies) AS BIGINT) AS class_size FROM texts JOIN roots USING (k) GROUP BY root)
SELECT d.doc_id, s.class_id, s.class_size FROM documents d JOIN roots r ON r.k = md5(coalesce(d.text, '')) JOIN sizes s USING (root)
"""

def _benchmark_sql() -> str:
    """The same templates, windows and slots, words and windows compared as lists."""
    listed = lambda names: ", ".join(f"'{w}'" for w in dict.fromkeys(names.split()))
    number = lambda w: f"(regexp_matches({w}, '[0-9]') OR lower({w}) IN ({listed(templates.NUMBERS)}))"
    slots = "('<n>', '<name>', '<u>')"
    later = "(m[i] = '<name>' AND i > 1 AND m[i - 1] = '<name>')"
    return rf"""
WITH texts AS (SELECT 'd' AS side, t, CAST(NULL AS BIGINT) AS item, row_number() OVER () AS r FROM (SELECT DISTINCT t FROM (SELECT coalesce(text, '') AS t FROM documents UNION ALL SELECT lower(text) FROM documents WHERE regexp_matches(text, '{templates.TITLES}')))),
given AS (SELECT coalesce(text, '') AS t, item_id AS item, 2 * row_number() OVER () AS r FROM benchmark),
every AS (SELECT * FROM texts UNION ALL SELECT 'b', t, item, r FROM given UNION ALL SELECT 'b', lower(t), item, r + 1 FROM given WHERE lower(t) <> t),
words AS (SELECT side, t, item, r, string_split(trim(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}\s\p{{Z}}]+', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), ' ') AS w FROM every),
kinds AS (SELECT side, t, item, r, w, [CASE
    WHEN {number('x')} THEN '<n>'
    WHEN regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') AND lower(x) NOT IN ({listed(templates.FUNCTION)}) THEN '<name>'
    WHEN i > 1 AND {number('w[i - 1]')} AND lower(x) IN ({listed(templates.UNITS)}) THEN '<u>'
    ELSE lower(x) END FOR x, i IN w] AS m FROM words),
tokens AS (
  SELECT side, t, item, r, [m[i] FOR i IN range(1, len(m) + 1) IF NOT {later}] AS tok,
    string_split(substr(array_to_string([CASE WHEN {later} THEN '_' ELSE ' ' END || lower(w[i]) FOR i IN range(1, len(m) + 1)], ''), 2), ' ') AS plain FROM kinds),
items AS (SELECT item, r, tok, plain, least(len(tok), {templates.WINDOW}) AS k FROM tokens WHERE side = 'b' AND len(tok) >= {templates.SHORTEST}),
iw AS (SELECT item, r, k, a AS iat, tok[a:a + k - 1] AS w, plain[a:a + k - 1] AS p FROM (SELECT *, unnest(range(1, len(tok) - k + 2)) AS a FROM items)),
iw2 AS (SELECT *, len([x FOR x IN w IF x IN {slots}]) AS slots FROM iw),
iw3 AS (SELECT *, count(*) OVER (PARTITION BY r) AS n FROM iw2 WHERE k - slots >= {templates.LITERAL}),
dw AS (SELECT r AS d, k, a AS pos, tok[a:a + k - 1] AS w, plain[a:a + k - 1] AS p FROM (SELECT r, tok, plain, k, unnest(range(1, len(tok) - k + 2)) AS a FROM tokens, (SELECT DISTINCT k FROM items) WHERE side = 'd' AND len(tok) >= k)),
met AS (SELECT DISTINCT d, i.item, i.r, CAST(i.n AS INTEGER) AS n, i.iat, dw.pos, [{{'a': i.p[j], 'b': dw.p[j]}} FOR j IN range(1, i.k + 1) IF i.w[j] IN {slots}] AS fills FROM dw JOIN iw3 i ON dw.k = i.k AND dw.w = i.w),
placed AS (SELECT *, pos - iat AS line, len([x FOR x IN fills IF x.a <> x.b]) = 0 AS own FROM met),
scoped AS (
  SELECT *, 0 AS scope, 0 AS place FROM placed UNION ALL SELECT *, 1, line FROM placed
  UNION ALL SELECT *, 2, CAST(floor(line / (2 * (n + {templates.WINDOW}))) AS BIGINT) FROM placed UNION ALL SELECT *, 3, CAST(floor((line + n + {templates.WINDOW}) / (2 * (n + {templates.WINDOW}))) AS BIGINT) FROM placed),
each AS (SELECT d, item, r, n, scope, place, iat, arg_min(fills, pos) AS fills, bool_or(own) AS own FROM scoped GROUP BY ALL),
vals AS (SELECT d, r, scope, place, x.a AS v, min(x.b) <> max(x.b) AS two FROM (SELECT d, r, scope, place, unnest(fills) AS x FROM each) GROUP BY ALL),
checked AS (SELECT d, r, scope, place, count(*) AS slot_values, count(*) FILTER (two) AS conflicts FROM vals GROUP BY ALL),
found AS (SELECT d, item, r, n, scope, place, count(*) AS found, count(*) FILTER (own) AS literal FROM each GROUP BY ALL),
judged AS (SELECT f.*, coalesce(slot_values, 0) AS slot_values, coalesce(conflicts, 0) AS conflicts, CASE WHEN coalesce(conflicts, 0) = 0 THEN found ELSE literal END AS windows FROM found f LEFT JOIN checked USING (d, r, scope, place)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, r ORDER BY windows DESC, scope, place, slot_values DESC, conflicts DESC) AS rn FROM judged) WHERE rn = 1),
leaks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, r // 2 ORDER BY r) AS nth FROM best WHERE windows >= greatest(1, least({templates.ENOUGH}, ceil(n * {templates.SHARE})))) WHERE nth = 1),
docs AS (SELECT row_number() OVER () AS o, doc_id, coalesce(text, '') AS t FROM documents),
hits AS (
  SELECT o, doc_id, l.*, 0 AS reading FROM docs JOIN texts x ON x.t = docs.t JOIN leaks l ON l.d = x.r UNION ALL
  SELECT o, doc_id, l.*, 1 FROM docs JOIN texts x ON x.t = lower(docs.t) AND x.t <> docs.t JOIN leaks l ON l.d = x.r WHERE regexp_matches(docs.t, '{templates.TITLES}'))
SELECT doc_id, item AS item_id, windows, CAST(n AS BIGINT) AS item_windows, slot_values, conflicts
FROM (SELECT *, row_number() OVER (PARTITION BY o, r // 2 ORDER BY reading) AS k FROM hits) WHERE k = 1
"""


def _licences_sql() -> str:
    idf, other, parts = licences.weights()
    rows = ", ".join(f"('{w}', {x!r})" for w, x in idf.items())
    cells = ", ".join(f"({-i}, '{licences.NAMES.get(n, n)}', '{w}', {x!r})" for i, (n, p) in enumerate(parts.items()) for w, x in p.items())
    return f"""
WITH idf(word, x) AS (VALUES {rows}), part(rank, licence, word, v) AS (VALUES {cells}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id // 100 AS VARCHAR), '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') AS path, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, row_number() OVER () AS l, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{licences.CUE}')),
words AS (SELECT r, l, w AS word, count(*) AS n FROM (SELECT r, l, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS w FROM lines) WHERE w <> '' GROUP BY ALL),
norms AS (SELECT r, l, sqrt(sum(power(n * coalesce(x, {other!r}), 2))) AS norm FROM words LEFT JOIN idf USING (word) GROUP BY r, l),
cosines AS (SELECT r, l, rank, licence, round(sum(n * v) / any_value(norm), 9) AS cosine FROM words JOIN norms USING (r, l) JOIN part USING (word) GROUP BY r, l, rank, licence),
best AS (SELECT r, max(cosine) AS cosine, arg_max(licence, {{'a': cosine, 'b': rank}}) AS licence FROM cosines GROUP BY r),
spoken AS (SELECT r, count(*) FILTER (NOT regexp_matches(line, '{licences.HEADER_CUE}') AND regexp_matches(line, '[^ \t\r]')) AS others FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) GROUP BY r),
scanned AS (SELECT d.r, doc_id, path, CASE WHEN cosine >= {licences.LEAST} THEN licence END AS own, coalesce(cosine, 0) AS cosine, others = 0 AS speaks FROM docs d LEFT JOIN best USING (r) JOIN spoken USING (r)),
up AS (SELECT *, string_split(path, '/') AS p FROM scanned),
levels AS (SELECT r, k, array_to_string(p[1:k], '/') AS directory, own FROM up, (VALUES (1), (2), (3)) AS v(k)),
directories AS (SELECT array_to_string(p[1:3], '/') AS directory, arg_min(own, {{'a': doc_id, 'b': own}}) AS licence FROM up WHERE own IS NOT NULL AND speaks GROUP BY directory),
near AS (SELECT r, arg_max({{'d': l.directory, 'licence': d.licence}}, k) AS got FROM levels l JOIN directories d USING (directory) WHERE own IS NULL GROUP BY r)
SELECT doc_id, path, own, cosine, coalesce(own, got.licence) AS licence, CASE WHEN own IS NULL THEN got.d END AS origin FROM scanned LEFT JOIN near USING (r)
"""


#: The levels of all trees one after another, then every leaf's way up them; crc32 bit by bit.
MERKLE = """
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS d, doc_id, lang, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS g, n_chars, {parts[0]} AS head, {parts[1]} AS tail FROM documents
), hashed AS (
  SELECT *, sha256(head || {count} || tail) AS leaf, sha256(head || {more} || tail) AS other,
    doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295], flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, CAST(x AS BIGINT)) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) % 7 = 0 AS hit FROM leaves
), placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM hashed),
up(g, level, r, n, h) AS (
  SELECT g, 0, r, n, leaf FROM placed UNION ALL
  SELECT g, any_value(level) + 1, r // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY r)) FROM up WHERE n > 1 GROUP BY g, r // 2),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS r, count(*) OVER () AS n FROM up WHERE n = 1),
over(level, r, n, h) AS (
  SELECT 0, r, n, subroot FROM subroots UNION ALL
  SELECT any_value(level) + 1, r // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY r)) FROM over WHERE n > 1 GROUP BY r // 2),
top AS (SELECT h AS root FROM over WHERE n = 1),
steps AS (
  SELECT d, u.level AS step, (p.r >> u.level) & 1 AS place, v.h AS other FROM placed p JOIN up u ON u.g = p.g AND u.r = p.r >> u.level AND u.n > 1 LEFT JOIN up v ON v.g = u.g AND v.level = u.level AND v.r = xor(u.r, 1)
  UNION ALL
  SELECT d, 1000 + u.level, (s.r >> u.level) & 1, v.h FROM placed p JOIN subroots s USING (g) JOIN over u ON u.r = s.r >> u.level AND u.n > 1 LEFT JOIN over v ON v.level = u.level AND v.r = xor(u.r, 1)),
ways AS (SELECT d, list({{'place': place, 'other': coalesce(other, '')}} ORDER BY step) AS way FROM steps GROUP BY d),
ready AS (SELECT p.*, coalesce(way, []) AS way FROM placed p LEFT JOIN ways USING (d)),
folds(d, k, h, way) AS (
  SELECT d, 0, CASE WHEN hit THEN other ELSE leaf END, way FROM ready UNION ALL
  SELECT d, k + 1, sha256(CASE WHEN way[k + 1].place = 1 THEN way[k + 1].other || h ELSE h || way[k + 1].other END), way FROM folds WHERE k < len(way)),
ends AS (SELECT d, h AS folded_root FROM folds WHERE k = len(way))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x.other FOR x IN way], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ready JOIN subroots USING (g) JOIN ends USING (d), top
"""


def _merkle_sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    head = " || ".join(f"({field(c)})" for c in ("doc_id", "source", "lang"))
    return MERKLE.format(parts=[head, field("text")], count=f"({field('n_chars')})", more=f"({field('(n_chars + 1)')})")


ORACLES: dict[str, str] = {"op11_merkle_manifest": _merkle_sql(), "op3_near_duplicates": NEAR_DUPLICATES, "op7_benchmark_leaks": _benchmark_sql(), "op8_licences": _licences_sql()}
