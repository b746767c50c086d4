"""Training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from tidemark.llm import ann, bpe_tree, common, exact_dedup, graph, lm_scoring, minhash, mixing, quality_fm, registry, repair, tool_calls, url_reputation

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string, node string, `left` string, size string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "eps", "zeta."]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    base = words(rng, 120)
    near = base.split()
    near[7] = "other"
    shared = words(rng, 60)
    out = [None, "", "  \n", "one", "one", "One two", base, base, base + "  ", " ".join(near), "x" * 5000, "é ñ\tü\n\n  end ", shared + " " + words(rng, 50), shared + " " + words(rng, 50), words(rng, 2000)]
    chain = base.split()
    for k in range(4):  # each a near copy of the one before
        chain = chain[:]
        chain[20 * k + 10] = f"chain{k}"
        out.append(" ".join(chain))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = [None, "b", "a", "b", "c"]
    rows = [(i * 3 + 1, t, "en", sources[i % 5], len(t or ""), "k", "m", "l", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6]], DOCS)  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def norm(t):
    return "".join(c for c in t or "" if c not in common.WHITE)


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_dedup(spark, docs, texts, digits):
    """digits=1 makes digests collide, so full bytes decide."""
    got = exact_dedup.exact_dedup(spark, docs, digits, files_per_batch=1).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id))
    assert len(got) == docs.count()
    for r in got:
        group = groups[norm(texts[(r.doc_id - 1) // 3])]
        assert (r.keep_id, r.group_size) == (min(group)[1], len(group))
        assert r.text_sha256 == hashlib.sha256(norm(texts[(r.doc_id - 1) // 3]).encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)


def test_near_dedup(docs, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i * 3 + 1] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_dedup(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert len({r.component_id for r in got}) < len(texts) - 3


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_near_dedup_of_a_single_short_text(spark, n):
    """A group whose texts hold fewer words in all than a shingle, or just as many."""
    text = " ".join(f"w{i}" for i in range(n))
    assert [len(s) for s in minhash.shingle_sets([text])] == [1]
    got = minhash.near_dedup(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(7, 1, 7, True)]


def test_near_dedup_settles_a_family_with_several_components(spark):
    """Copies of one text that differ too much from its centre but not from each other are linked by the second phase."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = base[:]
        for k in rng.sample(range(200), 4 + i % 7):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = list(range(60))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(df, block=16).collect()}
    assert got == {i: find(i) for i in range(60)}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    errors = []
    for n in (1, 3, 40, 400, 2000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: math.ceil(0.8 * len(a))], rng.integers(0, 1 << 62, len(a) // 5).astype(np.uint64)]))
        s = minhash.sketches([a, b])
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        errors.append(abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    assert max(errors) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, texts):
    reference = encoding()
    for r in bpe_tree.bpe(docs).collect():
        text = texts[(r.doc_id - 1) // 3] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(text) and r.decoded == text.encode() and r.n_tokens * 4 == len(r.ids)


def test_ordinary_words_are_joined_in_the_tree(docs):
    tree, reference = bpe_tree.TreeEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), encoding()
    text = "Threouin queévi onatreti anedstwh chkeitch fonction extraordinairement"
    assert np.frombuffer(tree.packed(text), "<u4").tolist() == reference.encode_ordinary(text) and tree.joins > 8


def test_tree_joins_are_exact():
    tree, reference, rng = bpe_tree.TreeEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), encoding(), random.Random(5)
    for _ in range(300):
        alphabet = rng.choice(["ab", "aaah", "ethaion", "éèüñ", "0123456789"])
        b = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 700))).encode()
        ids = tree.piece(b)
        assert ids == reference._core_bpe.encode_single_piece(b) and tree.decode(ids) == b
    for text in ("", " ", "a ", "  a", "a  b", "\n\n x \t y", "it's he'll", "a\x1cb \x85c", "<|endoftext|> a"):
        assert np.frombuffer(bpe_tree.encode_runs(text, bpe_tree.Runs(), lambda ss: [tree.packed(s) for s in ss]), "<u4").tolist() == reference.encode_ordinary(text)


def test_token_files(spark, docs, texts):
    path = common.new_path(spark, "test-ids")
    repair.write_ids(docs, path, block_tokens=700, least=2)
    reference, start = encoding(), 0
    got = repair.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    for r in got:
        ids = [*reference.encode_ordinary(texts[(r.doc_id - 1) // 3] or ""), 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    assert spark.read.parquet(path).select(F.sum(F.length("rules"))).first()[0] > 0
    for r in repair.read_documents(spark, path, [1, 43, 10**9]).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*reference.encode_ordinary(texts[(r.doc_id - 1) // 3] or ""), 2]
    assert {r.doc_id for r in repair.read_documents(spark, path, [1, 43, 10**9]).collect()} == {1, 43}


def test_packed_texts_are_those_of_whole_texts():
    """Texts with white space around spaces, which can't be cut everywhere, beside others, with a table that is full at once."""
    reference, table = encoding(), repair.PieceTable(public_tokenizers.path("byte_bpe_50k.json"), most=1)
    rng = random.Random(9)
    texts = ["", " ", "a ", "  a", "a  b", "\n\n x \t y", "it's he'll", "a\x1cb \x85c", "<|endoftext|> a", "a \n b", " x", "x", "x y \n\n z  w\t q "]
    texts += ["".join(rng.choice(["a", "b c", " ", " ", "\n", "'s", "7", ".", "é", "\u00a0"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    for group in (texts, texts[:1], texts[::-1], []):
        assert [x.tolist() for x in table.pack(group)] == [reference.encode_ordinary(t) for t in group]


def test_new_matches_go_to_the_library_together():
    """Thousands of new words, some with signs, digits and letters of other scripts at their ends, are some dozens of texts for the library, and a
    table that forgets gives the same ids."""
    reference, rng, given = encoding(), random.Random(3), []
    words = ["".join(rng.choice(["a", "e", "st", "ing", "Q", "é", "日", "٣", "7", ".", "'s", "\u0301", "\x1c", "ǅ"]) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    for most in (500_000, 1000):
        table = repair.PieceTable(public_tokenizers.path("byte_bpe_50k.json"), most=most)
        encoded, given = table.encoded, []
        table.encoded = lambda strings, e=encoded, g=given: (g.extend(strings), e(strings))[1]  # noqa: B023
        for part in (words[:3000], words[3000:], words[:3000]):
            assert table.pack(["x " + " ".join(part)])[0].tolist() == reference.encode_ordinary("x " + " ".join(part))
        spaced = [x for x in given if x[0] == " " and x[1:2].strip()]
        assert len(spaced) < 100
        assert all((table.head == [p[0] == " " for p in table.code]).tolist()) and len(table.head) == len(table.size) == len(table.code)


def test_token_files_hold_the_ids_of_plain_calls(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "a b", "<|endoftext|>", None, "x<|endoftext|><|endoftext|>  y\n", "<|endoftext", "  <|endoftext|>  b", "plain \n text"]
    path, start = common.new_path(spark, "test-added"), 0
    repair.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    got = repair.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    for r, t in zip(got, texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    seq = rng.zipf(1.5, 20000).clip(1, 500).astype(np.uint32)
    ends = np.sort(rng.choice(np.arange(1, 20000), 30, replace=False))
    ends = np.concatenate([ends, [20000]])
    rules, lengths, out, new_ends = repair.compress(seq, ends, 1000, 300, 4)
    table = repair.expansions(rules, lengths, 1000)
    assert len(out) < len(seq) and (repair.expand(out, table) == seq).all()
    for a, b, x, y in zip([0, *ends[:-1]], ends, [0, *new_ends[:-1]], new_ends):
        assert (repair.expand(out[x:y], table) == seq[a:b]).all() and (repair.expand_few(out[x:y], rules, 1000) == seq[a:b]).all()
    inside = np.ones(len(out) - 1, bool)
    inside[new_ends[:-1] - 1] = False
    left = Counter(zip(out[:-1][inside].tolist(), out[1:][inside].tolist()))
    assert max(n if a != b else (n + 1) // 2 for (a, b), n in left.items()) < 4  # nothing recurs that could be replaced


def test_a_repeated_passage_becomes_few_symbols():
    passage = np.random.default_rng(1).integers(0, 1000, 700).astype(np.uint32)
    seq = np.tile(passage, 64)
    rules, lengths, out, _ = repair.compress(seq, np.array([len(seq)]), 1000, 300, 4)
    assert (repair.expand(out, repair.expansions(rules, lengths, 1000)) == seq).all() and len(out) < 400 and lengths.max() >= 500


def test_mixing(docs, texts):
    got = mixing.mix(docs, shards=4).collect()
    again = mixing.mix(docs, shards=4).collect()
    assert sorted(got) == sorted(again)
    size = lambda t: len((t or "").encode().split())
    rows = docs.collect()
    total, per = 1.5 * sum(size(r.text) for r in rows), defaultdict(int)
    for r in rows:
        per[r.source] += size(r.text)
    order = sorted((s for s in per if s is not None)) + [None]
    weight, target, fixed = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        target = fixed | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 2 * per[s]]
        if not over:
            break
        fixed |= {s: 2 * per[s] for s in over}
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size(texts[(r.doc_id - 1) // 3]) and r.source_size == per[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size and len(r.shards) == r.copies
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max([size(r.text) for r in rows if r.source == s])


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = [("0a", 1000), ("0b", 37), ("1", 0)]
    got = mixing.split_quotas(spark.createDataFrame(quotas, "sk string, q long"), 8, 3).collect()
    assert {k: sum(r.n for r in got if r.sk == k) for k, _ in quotas} == dict(quotas)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n
    assert max(sizes.values()) - min(sizes.values()) <= 3 and min(r.n for r in got) >= 0
    draws = spark.range(2000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(100).cast("long"), F.lit(20).cast("long"), mixing.uniform(F.col("id"))).alias("x"))
    m, v = draws.agg(F.avg("x"), F.var_pop("x")).first()
    assert abs(m - 6) < 0.15 and abs(v - 20 * 0.3 * 0.7 * 80 / 99) < 0.4


def test_mixed_rows_follow_the_plan(docs):
    rows = mixing.mixed_rows(docs, shards=2)
    assert rows.columns == docs.columns
    plan = Counter()
    for r in mixing.mix(docs, shards=2).collect():
        plan[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in rows.collect()) == +plan


def test_quality(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality_fm.quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)


def test_machine_matches_its_definition(docs, texts):
    rng = np.random.default_rng(0)
    model = {"b": 0.1, "w": rng.normal(size=quality_fm.SIZE), "v": rng.normal(size=(quality_fm.SIZE, quality_fm.FACTORS))}
    indptr, indices, values = quality_fm.features(texts[:6], [1] * 6)
    raw, _ = quality_fm.raw_scores(indptr, indices, values, model)
    for d in range(6):
        i, x = indices[indptr[d] : indptr[d + 1]], values[indptr[d] : indptr[d + 1]]
        pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert math.isclose(raw[d], model["b"] + model["w"][i] @ x + pairs, rel_tol=1e-8)


@pytest.mark.parametrize("order, least", [(1, 1), (2, 1), (3, 1), (4, 1), (1, 2), (2, 2), (3, 2)])
def test_stupid_backoff(docs, order, least):
    """With sample_every=1 the commonest histories take the route of hot ones."""
    rows = docs.collect()
    split = [(r.doc_id, (r.text or "").encode().lower().split()) for r in rows]
    counts = Counter(tuple(w[j : j + k]) for _, w in split for k in range(1, order + 1) for j in range(len(w) - k + 1))
    total = sum(len(w) for _, w in split)

    def score(w):
        s = 0.0
        for j in range(len(w)):
            dropped = 0.0
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if k == 1 or counts[g] >= least:
                    s += dropped + math.log(counts[g] / (counts[g[:-1]] if k > 1 else total))
                    break
                dropped += math.log(0.4)
        return s

    want = sorted((i, len(w), round(score(w), 6)) for i, w in split)
    got = lm_scoring.stupid_backoff(docs, order, least, sample_every=1).collect()
    assert sorted((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_registered_scores_use_trigrams_and_all_counts(spark, tmp_path):
    rng = random.Random(11)
    split = [[f"w{rng.randrange(12)}" for _ in range(rng.randrange(60))] for _ in range(40)]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(split)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter(tuple(w[j : j + k]) for w in split for k in (1, 2, 3) for j in range(len(w) - k + 1))
    total = sum(map(len, split))

    def score(w):
        grams = [tuple(w[max(0, j - 2) : j + 1]) for j in range(len(w))]
        return sum(math.log(counts[g] / (counts[g[:-1]] if len(g) > 1 else total)) for g in grams)

    got = lm_scoring.op1_lm_score(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in got) == [(i, len(w), 0, round(score(w), 6)) for i, w in enumerate(split)]


@pytest.mark.parametrize("size", ["float", "double"])
def test_nearest_keeps_the_type_of_the_vectors(spark, size):
    """Doubles that floats can't hold are scored as they are; rows that share an id and differ are both searched."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) * (1e60 if size == "double" else 1)
    x = x.astype(np.float32).astype(float) if size == "float" else x
    rows = [(i % 58, [float(c) for c in v]) for i, v in enumerate(x)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{size}>"), k=5, every=20).collect():
        got[r.query_id].append(r)
    assert sorted(got) == [0, 20, 40] and all(len({r.rank for r in g}) == 5 for g in got.values())
    for r in got[20]:
        assert any(math.isclose(r.score, float(np.dot(x[20], x[j])), rel_tol=1e-12) for j in range(60) if j % 58 == r.vec_id)


def test_recall_on_the_embeddings(spark):
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    pdf = rows.toPandas().drop_duplicates("vec_id")
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    found = defaultdict(set)
    for r in ann.op8_nearest(spark, "/root/testdata/sf0.1").collect():
        found[r.query_id].add((r.vec_id, round(r.score, 9)))
    hits = []
    for q in found:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        kth = np.sort(s)[-20] - 1e-9
        hits.append(sum(score >= kth for _, score in found[q]) / 20)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 8)), 2).astype(np.float32)
    x[50:80] = x[40]
    rows = [(i, [float(c) for c in v], "n") for i, v in enumerate(x)] + [(1000, None, "n"), (1020, [0.0] * 8, "n"), (1040, [float("nan")] * 8, "n"), (1060, [1.0, None] * 4, "n"), (1080, [1.0], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = defaultdict(list)
    for r in ann.nearest(df, k=20, block_rows=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        best = [i for i in sorted(range(300), key=lambda i: (-round(s[i], 9), i)) if i != q][:20]
        assert len(found) == 20 and q not in dict(found) and all(abs(s[i] - v) < 1e-9 for i, v in found)
        hits += len(set(best) & {i for i, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    few = ann.nearest(df.filter("vec_id < 3")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2)]


def test_urls(spark):
    pages = [(1, "http://www.Example.com/en/1?x", "h"), (2, "https://a.net/fr/2#t", "h"), (3, None, "h"), (4, "no scheme", "h"), (5, "http://b.org/3", "h"), (5, "http://b.org/3", "h"), (6, "x://blog.example.com/en/", "h"), (7, "http://example.net", "h")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    labels = spark.createDataFrame([(3, 0, 0), (3, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.url_filter(df, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (1, 2, 3, 4, 6, 7)] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("a.net", "/fr/2", "net/fr/"), ("", "", None), ("", "", None), ("blog.example.com", "/en/", "example.com/en/"), ("example.net", "", None),
    ]
    assert (got[5].host_labelled, got[5].host_good, got[1].verdict, got[2].verdict) == (2, 0, "allow", "block")
    assert url_reputation.url_filter(df.limit(0), labels).count() == 0


def test_tool_calls(spark):
    calls = [("c1", 1, 0, "reply", '{"turn": 0, "prompt": "a\\"b"}'), ("c2", 1, 1, "reply", '{"prompt": "", "extra": 1}'), ("c3", 1, 2, "other", "{}"), ("c4", 1, 3, "reply", "not json"), ("c5", 1, 4, "reply", None), ("x", 2, 0, "reply", "{}"), ("y", 2, 1, "reply", "{}"), (None, 3, 0, "reply", "{}"), ("c1", 1, 0, "reply", '{"turn": 0, "prompt": "a\\"b"}')]
    edges = [("c2", "c1"), ("c3", "c2"), ("c4", "c3"), ("c4", "c1"), ("c5", "c4"), ("x", "y"), ("y", "x"), ("c5", "gone")]
    results = [("c1", "ok"), ("c1", "again"), ("zz", "lost"), (None, "n")]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = {r.call_id: r for r in tool_calls.link_tool_calls(df(calls, "call_id string, conv_id long, turn long, name string, arguments string"), df(results, "call_id string, content string"), df(edges, "call_id string, dep string")).collect()}
    assert {k: r.level for k, r in got.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": 3, "c5": 4, "x": None, "y": None, "zz": None}
    assert json.loads(got["c1"].json) == {"arguments": {"prompt": 'a"b', "turn": 0}, "id": "c1", "name": "reply", "result": "again"}
    assert (got["c1"].errors, got["c1"].n_results) == ("", 2)
    assert got["c2"].errors == "prompt: below 1; turn: missing; unknown argument" and got["c3"].errors == "unknown tool" and "cycle" in got["x"].errors


CALLS, RESULTS, EDGES = "call_id string, conv_id long, turn long, name string, arguments string", "call_id string, content string", "call_id string, dep string"


def linked(spark, calls, results=(), edges=()):
    df = lambda rows, s: spark.createDataFrame(list(rows), s)
    return {r.call_id: r for r in tool_calls.link_tool_calls(df(calls, CALLS), df(results, RESULTS), df(edges, EDGES)).collect()}


def test_tool_call_types_are_those_of_json(spark):
    schemas_errors = {
        '{"prompt": 5, "turn": "7"}': ("prompt: not string; turn: not integer", '{"prompt":5,"turn":"7"}'),
        '{"turn":1, "prompt":"p","extra":1,"o":{"b":1,"a":[2,{"z":1,"y":null}]}}': ("unknown argument", '{"extra":1,"o":{"a":[2,{"y":null,"z":1}],"b":1},"prompt":"p","turn":1}'),
        '{"prompt":"p","turn":1,"turn":2}': ("duplicate key", None),
        '{"prompt":{"a":1,"a":1},"turn":1}': ("duplicate key", None),
        '{"prompt":null,"turn":1}': ("prompt: not string", '{"prompt":null,"turn":1}'),
        '{"prompt":"p","turn":1.0}': ("", '{"prompt":"p","turn":1}'),
        '{"prompt":"p","turn":1.5}': ("turn: not integer", '{"prompt":"p","turn":1.5}'),
        '{"prompt":"p","turn":-1}': ("turn: below 0", '{"prompt":"p","turn":-1}'),
        '{"prompt":"p","turn":true}': ("turn: not integer", '{"prompt":"p","turn":true}'),
        '["prompt","turn"]': ("not an object", '["prompt","turn"]'),
        "not json": ("not an object", '"not json"'),
        "": ("not an object", '""'),
        None: ("not an object", "null"),
        '{"turn":3,"prompt":"' + "x" * 100000 + '"}': ("", '{"prompt":"' + "x" * 100000 + '","turn":3}'),
        '{"prompt":"\\u00e9\\n\\"","turn":2}': ("", '{"prompt":"é\\n\\"","turn":2}'),
        '{"prompt":"x","turn":1} trailing': ("trailing text", None),
        '{"prompt":"x","turn":1}{"prompt":"x","turn":1}': ("trailing text", None),
        '{"prompt":"x","turn":1}, {"prompt":"x","turn":1}': ("trailing text", None),
        '{"prompt":"x","turn":1}] x': ("trailing text", None),
        ' {"prompt":"x","turn":1}\n': ("", '{"prompt":"x","turn":1}'),
        '{"prompt":"1e2 and 7E1","turn":1e2}': ("", '{"prompt":"1e2 and 7E1","turn":100}'),
        '{"prompt":"x","turn":-2.5e-1}': ("turn: not integer", '{"prompt":"x","turn":-0.25}'),
        '{"prompt":"x","turn":1E+18}': ("", '{"prompt":"x","turn":1000000000000000000}'),
        '{"prompt":"x","turn":0e5}': ("", '{"prompt":"x","turn":0}'),
        '{"prompt":"x","turn":' + "12" * 19 + "}": ("", '{"prompt":"x","turn":' + "12" * 19 + "}"),
        '{"prompt":"x","turn":' + "123456" * 7 + "}": ("inexact number", None),
        '{"prompt":"' + "123456" * 7 + ' \\" 1","turn":5}': ("", '{"prompt":"' + "123456" * 7 + ' \\" 1","turn":5}'),
        '{"prompt":"' + "\\n1e5 " * 20000 + '","turn":5}': ("", '{"prompt":"' + "\\n1e5 " * 20000 + '","turn":5}'),
        '{"turn":5,"prompt":"x","prompt":"y","turn":' + "123456" * 7 + "}": ("duplicate key", None),
    }
    got = linked(spark, [(f"c{i}", 1, i, "reply", a) for i, a in enumerate(schemas_errors)])
    for i, (a, (errors, canonical)) in enumerate(schemas_errors.items()):
        r = got[f"c{i}"]
        assert r.errors == errors, a
        assert r.json == '{"arguments":' + (json.dumps(a) if canonical is None else canonical) + f',"id":"c{i}","name":"reply","result":null}}'


def test_results_without_a_call_and_repeated_turns(spark):
    got = linked(spark, [("a", 1, 1, "reply", '{"prompt":"y","turn":1}'), ("a", 1, 1, "reply", '{"prompt":"x","turn":1}')], [("lost", "r"), ("lost", None), (None, "n"), ("a", None)])
    assert sorted(got) == ["a", "lost"]
    assert tuple(got["lost"]) == (None, "lost", None, None, None, 2, "no call", '{"arguments":null,"id":"lost","name":null,"result":"r"}')
    assert (got["a"].n_results, got["a"].json) == (1, '{"arguments":{"prompt":"x","turn":1},"id":"a","name":"reply","result":null}')


def test_levels_of_long_chains_take_few_rounds(spark, monkeypatch):
    n = 60
    calls = spark.createDataFrame([(f"c{i}", i, "z") for i in range(n)] + [("x", None, "z"), ("y", 5, "z"), ("w", 6, "z")], "call_id string, turn long, at string")
    edges = [(f"c{i}", f"c{j}") for i in range(n) for j in (i - 1, i - 2, i - 3) if j >= 0] + [("x", "y"), ("y", "x"), ("w", "y"), ("w", "c0"), ("x", "c0"), ("y", "c0")]
    written = []
    real = common.staged
    monkeypatch.setattr(tool_calls, "staged", lambda df, name: written.append(name) or real(df, name))
    got = {r.call_id: r.level for r in tool_calls.levels(calls, spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {f"c{i}": i for i in range(n)} and len(written) < 20


def test_levels_match_the_longest_chains(spark):
    rng = random.Random(3)
    edges = {(i, rng.randrange(i)) for i in range(1, 80) for _ in range(rng.choice([1, 1, 2, 4]))}
    turns = [(str(i), i if rng.random() < 0.8 else 79 - i) for i in range(80)]
    level = {}
    for i in range(80):
        level[i] = max((level[d] + 1 for c, d in edges if c == i), default=0)
    got = {int(r.call_id): r.level for r in tool_calls.levels(spark.createDataFrame(turns, "call_id string, turn long"), spark.createDataFrame([(str(a), str(b)) for a, b in edges], EDGES)).collect()}
    assert got == level


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_dedup(spark, empty).count() == 0
    assert minhash.near_dedup(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(empty).count() == 0
    assert bpe_tree.bpe(empty).count() == 0
    assert lm_scoring.stupid_backoff(empty).count() == 0
    assert quality_fm.quality(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert tool_calls.link_tool_calls(*tool_calls.from_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    path = common.new_path(spark, "test-empty")
    repair.write_ids(empty, path)
    assert repair.read_ids(spark, path).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = common.table(spark, SF, "documents")
    seen = {}
    for name, stage in p.STAGES:
        new = common.staged(stage(spark, docs, SF), "test-stage")
        if name != p.STAGES[-1][0]:
            assert new.columns == docs.columns
        seen[name], docs = new, new
    kept = {r.doc_id for r in seen["minhash near-dedup"].collect()}
    assert kept <= {r.doc_id for r in seen["exact dedup"].collect()} and {r.doc_id for r in seen["mixing"].collect()} <= kept
    assert docs.count() == seen["mixing"].count()
    texts = {r.doc_id: r.text for r in seen["mixing"].collect()}
    assert all(hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.decoded_sha256 for r in docs.collect())


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in registry.QUERIES} == {f"op{n}" for n in range(1, 11)}
