"""Merkle manifests, token alignment and language mixtures against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dotweave.llm import alignment, languages, merkle
from dotweave.llm.queries import tokenizer_path

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    """(root, per leaf the list of (place, others))."""
    level, spans, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        above, wider = [], []
        for i in range(0, len(level), fanout):
            kids = level[i : i + fanout]
            for j in range(len(kids)):
                for leaf in spans[i + j]:
                    proofs[leaf].append((j, kids[:j] + kids[j + 1 :]))
            above.append(sha(*kids))
            wider.append(sum(spans[i : i + fanout], []))
        level, spans = above, wider
    return level[0], proofs


@pytest.mark.parametrize("fanout, segment", [(2, 4096), (2, 8), (3, 9), (5, 5)])
def test_manifest_equals_brute_force(spark, monkeypatch, fanout, segment):
    """Groups of many sizes, one of them hot, null names and ids, equal ids and equal rows; small segments make deep descents."""
    monkeypatch.setattr(merkle, "SEGMENT", segment)
    rng = random.Random(fanout * segment)
    rows = [(rng.choice([None, "", "a", "b", "é", "Z"]) if k % 3 else "hot", rng.choice([None, k, 7, 8]), rng.choice(["x", "yy", None, "é" * 9])) for k in range(150)]
    rows += [("one", 1, "x")] + [("hot", 5, "same")] * 70  # a single leaf, and equal rows whose segments are equal
    df = spark.createDataFrame([r + ("n", "p") for r in rows], "name string, id bigint, text string, `rank` string, `n` string")
    leaves = df.select(merkle.group_key(F.col("name")).alias("group"), "id", merkle.leaf([F.col("id"), F.col("text")]).alias("digest"))
    got = merkle.manifest(leaves, ["id"], fanout).withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect()

    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for name, i, text in rows:
        groups[(name is not None, (name or "").encode())].append(((i is not None, i or 0, sha(field(i), field(text))), i))
    roots, want = [], Counter()
    trees = {}
    for key in sorted(groups):
        ordered = sorted(groups[key])
        trees[key] = (ordered, *tree([leaf[2] for leaf, _ in ordered], fanout))
        roots.append(trees[key][1])
    root, over = tree(roots, fanout)
    for key, above in zip(sorted(groups), over):
        ordered, subroot, proofs = trees[key]
        for (leaf, i), proof in zip(ordered, proofs):
            want[(i, leaf[2], subroot, root, str(proof + above))] += 1
    found = Counter((r["id"], r["leaf"], r["subroot"], r["root"], str([(s["place"], s["others"]) for s in r["proof"]])) for r in got)
    assert found == want
    assert all(r["folded"] == root for r in got)


def test_a_part_of_the_requests_and_what_is_not_there(spark):
    nodes = spark.createDataFrame([("+g", k, 20, sha(str(k))) for k in range(20)], "group string, rank bigint, n bigint, digest string")
    made = merkle.build(nodes)
    root = made.roots.first()["digest"]
    assert made.records.count() == 10 + 5 + 3 + 2 + 1
    paths = spark.createDataFrame([("+g", 20, root)], "group string, n bigint, digest string").withColumn("above", F.array().cast(merkle.PROOF))
    wanted = spark.createDataFrame([("+g", 3, "a"), ("+g", 19, "b"), ("+g", 20, "beyond"), ("+other", 0, "none")], "group string, rank bigint, note string")
    got = {r["note"]: r for r in merkle.prove(made, wanted, paths).withColumn("root", merkle.folded(F.col("digest"), F.col("proof"))).collect()}
    assert set(got) == {"a", "b"} and got["a"]["digest"] == sha("3") and got["b"]["digest"] == sha("19")
    assert {r["root"] for r in got.values()} == {root}


def test_tampering_shows(spark):
    leaves = spark.createDataFrame([("", k, sha(str(k))) for k in range(9)], "group string, id bigint, digest string")
    proofs = merkle.manifest(leaves, ["id"]).withColumn("other", merkle.folded(F.sha2(F.lit("x").cast("binary"), 256), F.col("proof"))).collect()
    assert len(proofs) == 9 and all(r["other"] != r["root"] for r in proofs)


def test_empty_manifest(spark):
    leaves = spark.createDataFrame([], "group string, id bigint, digest string")
    assert merkle.manifest(leaves, ["id"]).count() == 0


def _brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(BYTE_LEVEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    entry = alignment.byte_level(tokenizer_path(BYTE_LEVEL))[1].tokens
    out, links, docs = {}, {}, Counter()
    for key, text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta = [entry[i] for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            out[key] = (0, 0, 0, 0, "")
            continue
        groups, x, y, i, j = [], 0, 0, 0, 0
        while i < len(ta):
            left, right = [ia[i]], [ib[j]]
            x, y, i, j = x + len(ta[i]), y + len(tb[j]), i + 1, j + 1
            while x != y:
                if x < y:
                    left.append(ia[i])
                    x, i = x + len(ta[i]), i + 1
                else:
                    right.append(ib[j])
                    y, j = y + len(tb[j]), j + 1
            groups.append((left, right))
        here = Counter()
        for left, right in groups:
            for p, n in Counter(left).items():
                for q, m in Counter(right).items():
                    here[p, q] += n * m
        links[key] = here
        docs.update(here.keys())
        named = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out[key] = (len(ia), len(ib), len(groups), sum(here.values()), sha(named))
    best = Counter()
    for (p, _), n in docs.items():
        best[p] = max(best[p], n)
    return {k: v[:4] + (sum(m for p, m in links.get(k, {}).items() if docs[p] == best[p[0]]), sum(m * docs[p] for p, m in links.get(k, {}).items()), v[4]) for k, v in out.items()}


def test_alignment_equals_brute_force(spark):
    """Scripts, emoji, control characters, strings of special tokens, long runs, texts that one side can't give back; counts by broadcast and by join."""
    rng = random.Random(3)
    stock = ["é", "日本語", "\U0001f600", "\n", "  ", "\t", "a", "the ", "word", "<s>", "<|endoftext|>", "\u0000", "ñ", " ", "œ", "한국", "​", "012", "...", "'s", "\r\n", "\xa0", "á"]
    rows = [(k, "".join(rng.choice(stock) for _ in range(rng.randrange(60)))) for k in range(150)] + [(150 + k, f"has the sign ▁ {k}") for k in range(3)]
    rows += [(1000, None), (1001, ""), (1002, " " * 5000), (1003, "日" * 2000), (1004, "=-" * 3000), (1005, "".join(rng.choice("日本中文") for _ in range(4000))), (1006, "the same"), (1007, "the same")]
    want = _brute_alignment(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, pairs string")
    for few in (alignment.FEW, 0):
        got = {r[0]: tuple(r)[1:] for r in alignment.score(df, ["doc_id"], tokenizer_path(BYTE_LEVEL), tokenizer_path(PIECES), few=few).collect()}
        assert got == want
    assert sum(v[0] == 0 for v in want.values()) >= 5 and max(v[3] for v in want.values()) > alignment.LARGE


def test_parts_and_large_groups_change_nothing(monkeypatch):
    """Texts cut at single spaces are aligned like whole ones, and groups linked by distinct ids like others."""
    a, b = alignment.byte_level(tokenizer_path(BYTE_LEVEL)), alignment.pieces(tokenizer_path(PIECES))
    assert alignment.separable(tokenizer_path(BYTE_LEVEL), tokenizer_path(PIECES))
    rng = random.Random(8)
    stock = ["the", "don't", "x's", "日本", "é", "...", "12,5", " ", "\n", "\t", "▁", "\U0001f600", "<s>", "\x1c", "\u2028", "ab-cd"]
    texts = ["    " * 40 + "a b" + "日本" * 30, "some plain words", " a ", "  two", "end  ", " "] + [" ".join(rng.choice(stock) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    same = lambda p, q: p[0] == q[0] and all((x == y).all() for x, y in zip(p[1], q[1]))
    memo = alignment.Memo()
    whole = alignment.aligned(texts, a, b, False, alignment.Memo())
    assert same(whole, alignment.aligned(texts, a, b, True, memo)) and sum(r[0] == 0 for r in whole[0]) > 10
    assert same(whole, alignment.aligned(texts, a, b, True, memo))  # now all are known
    monkeypatch.setattr(alignment, "LARGE", 1)
    memo = alignment.Memo()
    assert same(whole, alignment.aligned(texts, a, b, True, memo))
    monkeypatch.setattr(alignment, "TOGETHER", 30)
    memo = alignment.Memo()
    assert same(whole, alignment.aligned(texts, a, b, True, memo))


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.score(df, ["doc_id"], tokenizer_path(BYTE_LEVEL), tokenizer_path(PIECES)).count() == 0


def plain_grams(text):
    """The n-grams themselves."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    joined = " " + " ".join(words) + " " if words else ""
    return [joined[i : i + n] for n in languages.SIZES for i in range(len(joined) - n + 1) if any(c != " " for c in joined[i : i + n]) and " " not in joined[i + 1 : i + n - 1]]


def test_grams_are_those_of_the_words():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("abÉé 日.1\n'İ") for _ in range(rng.randrange(25)))
        want = Counter(plain_grams(text))
        got = Counter(languages._grams(text, 1 << 16).tolist())
        assert sorted(want.values()) == sorted(got.values())


ALPHABETS = {"xa": "abcdefgh", "xb": "efghijkl", "xc": "ijklmnop"}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(words))


def test_mixtures_are_found(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, lang, 60), lang) for k in range(90) for lang in ALPHABETS] + [(1, None, "xa"), (2, "", "xb"), (None, prose(rng, "xa", 9), "xd"), (3, prose(rng, "xb", 30), None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, lang string, score string, lang_pred string")
    model = languages.fit(docs, F.col("doc_id").isNotNull())
    assert model.names == ["xa", "xb", "xc"] and model.logs.shape == (languages.BUCKETS, 3)
    assert [languages.infer(prose(rng, lang, 8), model)[0] for lang in ALPHABETS for _ in range(20)] == [lang for lang in ALPHABETS for _ in range(20)]
    for parts in ({"xa": 70, "xb": 30}, {"xb": 100, "xc": 60, "xa": 40}):
        text = " ".join(prose(rng, lang, 5) for lang, n in parts.items() for _ in range(n))
        name, score, mixture = languages.infer(text, model)
        total = sum(parts.values())
        assert [k for k, _ in mixture] == sorted(parts, key=lambda k: -parts[k]) and name == mixture[0][0]
        assert all(abs(v - parts[k] / total) < 0.05 for k, v in mixture) and abs(score - mixture[0][1]) < 0.01
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. \U0001f600"), (4, prose(rng, "xc", 30_000)), (4, "ab"), (None, "ab")], "doc_id bigint, text string")
    got = languages.predict(odd, model, ["doc_id"]).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "xc"), (4, "xa"), (None, "xa")]
    assert [r["score"] for r in got[:3]] == [0, 0, 0] and all(0 < r["score"] <= 1 for r in got[3:]) and got[0]["languages"] == []
    assert languages.predict(odd.where("false"), model, ["doc_id"]).count() == 0
    nothing = languages.fit(docs.where("false"), F.lit(True))
    assert languages.infer("abc", nothing) == ("und", 0.0, [])


def test_counts_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, prose(rng, lang, 20), lang) for k in range(20) for lang in ALPHABETS], "doc_id bigint, text string, lang string")
    one, many = (languages.fit(docs.repartition(n), F.lit(True)) for n in (1, 7))
    assert one.names == many.names and (one.logs == many.logs).all()


def test_languages_of_held_out_documents(spark):
    from dotweave.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op13_language_mixtures(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[0] > 0.99 and right[1] > 200
