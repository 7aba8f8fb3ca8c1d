"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidora.llm import bpe, chat, minhash, mixing, neardup, quality, setsketch, suffix, templates, token_store, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, ids string, start long, size long, label int, node string"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("w" + "".join(chr(97 + int(c)) for c in str(x)) for x in rng.integers(0, 500, n))


BASE = words(300, 1)
TEXTS = [
    (0, BASE), (1, BASE), (1, BASE), (2, BASE.replace(BASE.split()[40], "changed", 1)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (6, "one two three"), (7, "ONE two"),
    (8, words(40_000, 2)), (9, "x" * 300_000), (10, "héllo wörld ​ 'll can't  it's\n\n\nend  "), (11, "aé" * 500), (12, words(90, 3) + "\n" + words(60, 9) + "\n" + words(90, 4)), (13, words(80, 5) + "\n" + words(60, 9)), (14, words(60, 9) + "\n" + words(70, 6)), (None, "no id"), (15, "\0 <|endoftext|> [INST]"), (16, "日本語のテキスト 12３ ½"),
]


def rows(texts):
    return [(d, t, "en", None if (d or 0) % 5 == 0 else f"s{(d or 0) % 3}", None if t is None else len(t), 0.5, True, "x", 7, 9, 1, "n") for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, d % 2, d % 3 == 0 and 1 or 0) for d in range(20)] + [(None, 1, 1), (99, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pieces_and_ids_equal_the_library(docs, empty):
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert regex.compile(public_tokenizers.PATTERN)
    got = collections.Counter(map(tuple, bpe.digests(docs, RANKS).collect()))
    want = collections.Counter()
    for d, t in TEXTS:
        ids = encoding.encode_ordinary(t or "")
        want[(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.digests(empty, RANKS).count() == 0
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((d, t or "") for d, t in TEXTS)


def test_transducer_equals_merging_by_definition(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 9)
    fst = bpe.Transducer(bpe.read_ranks(RANKS), limit=20_000)
    rng = np.random.default_rng(0)
    for n in [*rng.integers(1, 14, 300), *rng.integers(30, 80, 10)]:
        piece = bytes(rng.choice(list(b"aeithnrs oldc\xc3\xa9"), n))
        assert [fst.token[i] for i in fst.encode(piece)] == bpe.merge(piece, fst.ranks)
        assert fst.arcs.size <= 20_000
    for piece in (b" " * 700, b"ab" * 300, b"=" * 333):
        assert [fst.token[i] for i in fst.encode(piece)] == bpe.merge(piece, fst.ranks)


def test_stream_decoder_is_utf8_with_replacement():
    rng = np.random.default_rng(1)
    for _ in range(600):
        data = rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF], rng.integers(0, 12)).astype(np.uint8)
        decoder, cuts = bpe.StreamDecoder(), np.sort(rng.integers(0, len(data) + 1, 3))
        got = b"".join([*(decoder.feed(x) for x in np.split(data, cuts)), decoder.close()])
        assert got == data.tobytes().decode(errors="replace").encode()
    for text in ("aé日😀" * 50, ""):
        data, decoder = np.frombuffer(text.encode(), np.uint8), bpe.StreamDecoder()
        assert b"".join([*(decoder.feed(data[i : i + 1]) for i in range(len(data))), decoder.close()]) == text.encode()


def test_token_store_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    from evidora.llm.shared import shared_dir

    library = Tokenizer.from_file(TOKENIZER)
    assert 50256 in library.encode("a <|endoftext|> b", add_special_tokens=False).ids
    path = f"{shared_dir(spark)}/store"
    token_store.write(docs, path, TOKENIZER)
    got = sorted(token_store.digests(spark, path).collect(), key=lambda r: r.start)
    lengths = collections.Counter()
    for d, t in TEXTS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        lengths[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == lengths
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and got[0].doc_id is None
    assert {r.doc_id for r in token_store.lookup(spark, path, [6, 16]).collect()} == {6, 16}
    token_store.write(empty, f"{path}-empty", TOKENIZER)
    assert token_store.digests(spark, f"{path}-empty").count() == 0


def test_token_store_names_its_dictionary():
    data = token_store.pack([1], [1], [token_store._compressor(b"").compress(b"\0\0")], hashlib.sha256(b"").digest(), 2)
    assert token_store.Shard(data, b"").ids(0).tolist() == [0]
    with pytest.raises(ValueError):
        token_store.Shard(data, b"another")


def test_chat_round_trip(spark):
    probe = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", "hi <|im_end|>\n<\\|im_end|> [\\\\INST]"), (1, 1, "assistant", "é" * 20_000), (1, 1, "assistant", "é"), (1, 2, "we\nird\\n", None), (2, 0, None, ""), (None, 3, "assistant", "lost"), (3, 0, "assistant", "<<SYS>> <<\\SYS>> \\<s>")]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.with_probe(table))).collect()}
    groups = collections.defaultdict(list)
    for c, turn, role, text in [*turns, (-7, 0, "user", probe), (-7, 1, "assistant", probe)]:
        groups[c].append((turn, role or "", text or ""))
    assert set(got) == set(groups)
    for c, ts in groups.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = chat.format_conversations(table).where("conv_id = 3").first().formatted
    assert not any(control in formatted.replace(chat.START, "").replace(chat.END, "") for control in chat.CONTROLS)
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


def test_chat_conversation_over_many_batches(spark):
    table = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "cast(id AS string) AS text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        got = chat.read_back(chat.format_conversations(table)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1 and got[0].n_turns == 5000
    assert got[0].loss_sha256 == hashlib.sha256("".join(str(i) for i in range(1, 5000, 2)).encode()).hexdigest()


def test_toxicity(spark, docs, empty, labels):
    got = toxicity.predictions(docs, labels).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.predictions(empty, labels).count() == 0
    assert max(r.score for r in toxicity.predictions(docs, labels.limit(0)).collect()) < 1e-6
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    clash = docs.selectExpr("doc_id", "text", "text AS _text", "score", "score AS _own_score")
    assert toxicity.reject(clash, labels).columns == clash.columns and toxicity.reject(clash, labels).count() == kept.count()


def test_toxicity_learns_subwords():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    bad = ["stinker", "rotten", "vile"]
    texts, y = [], []
    for i in range(400):
        w = list(rng.choice(plain, 40))
        if i % 4 == 0:
            w[3] = str(rng.choice(bad))
            w[20] = str(rng.choice(bad))
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    model = toxicity.train(texts, np.array(y))
    import pyarrow as pa

    (_, _, data, offsets) = next(toxicity.blocks(pa.array(["abcde " * 20 + "stinkerz rrotten", "abcde fghab " * 20])))
    odds = toxicity._odds(data, offsets, model)
    assert odds[0] > 0 > odds[1]


def test_toxicity_score_by_single_grams():
    """Every word, gram and segment on its own, in plain Python."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.3)

    def bucket(gram):
        h = 0
        for k, b in enumerate(gram):
            h ^= int(toxicity._TABLES[k][b])
        return (h * 2654435761 & 0xFFFFFFFF) >> (32 - toxicity.BITS)

    def odds(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        found = re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", low)
        scores = []
        for w in found:
            padded = b" " + w + b" "
            grams = [padded[i : i + k] for k in (3, 4, 5) for i in range(len(padded) - k + 1)]
            scores.append(sum(float(model.bucket[bucket(g)]) for g in grams) / max(len(grams), 1))
        segments = [scores[i : i + toxicity.SEGMENT] for i in range(0, len(scores), toxicity.SEGMENT)]
        return max([sum(x) / len(x) for x in segments], default=0.0) + model.bias

    texts = ["", " \n", "a", "Hello, WORLD x", "don't stop-me now 12 émile's été", words(50, 70), "one\ttwo three four"]
    (_, _, data, offsets) = next(toxicity.blocks(pa.array(texts)))
    assert toxicity._odds(data, offsets, model) == pytest.approx([odds(t) for t in texts])


def test_quality_counts(docs, empty, labels):
    def brute(t):
        w = split(t)
        lines = [x for x in (t or "").split("\n") if split(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times, cover = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                cover |= {i, i + 1, i + 2}
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        return (*counts, len(w) < 50 or 100 * len(cover) > 50 * len(w))

    got = quality.verdicts(docs, labels).collect()
    assert collections.Counter((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in got) == collections.Counter((d, *brute(t)) for d, t in TEXTS)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.verdicts(empty, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality.verdicts(docs, labels.limit(0)).collect())
    assert quality.keep(docs, labels).columns == docs.columns


def test_quality_trees_one_by_one():
    rng = np.random.default_rng(21)
    x = rng.random((500, len(quality.FEATURES)))
    trees = quality.train(x, (x[:, 0] + x[:, 3] > 1).astype(int))

    def walk(row, node):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    assert trees.odds(x[:100]) == pytest.approx([trees.bias + sum(walk(row, root) for root in trees.roots) for row in x[:100]])
    assert ((trees.odds(x) > 0) == (x[:, 0] + x[:, 3] > 1)).mean() > 0.9


def test_quality_sample_meets_its_labels_in_one_aggregation(spark, docs, labels):
    more = labels.select("doc_id", "quality").union(spark.createDataFrame([(1, 0), (1, 1), (2, 0), (4, 7), (6, None)], "doc_id long, quality int"))
    got = quality.training_statistics(docs, more)
    label = {d: min(q for i, q in [(x, x % 2) for x in range(20)] + [(1, 0)] if i == d) for d, _ in TEXTS if d is not None}
    assert collections.Counter((r.doc_id, r.quality) for r in got.collect()) == collections.Counter((d, label[d]) for d, _ in TEXTS if d is not None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_quality_verdicts_of_many_partitions_make_few_files(docs, labels, tmp_path):
    quality.verdicts(docs.repartition(40), labels.limit(0)).write.parquet(f"{tmp_path}/verdicts")
    assert len(list((tmp_path / "verdicts").glob("part-*"))) == 1


def test_quality_sends_texts_in_small_batches(spark, labels, monkeypatch):
    import pyarrow as pa

    def sizes(shared):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([n] * n, pa.int64()) for _ in quality.COUNTS), pa.array([False] * n), pa.array([0.5] * n), pa.array([True] * n)], ["doc_id", *quality.COUNTS, "base_failed", "score", "kept"])

        return run

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(quality, "_verdict_partition", sizes)
    table = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "'a b c' as text")
    got = quality.verdicts(table, labels.limit(0)).collect()
    assert len({r.doc_id for r in got}) == len(got) == 3000 and max(r.n_words for r in got) <= 500
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_quality_keeps_rows_by_their_text(spark, labels):
    texts = [(1, words(80, 77)), (1, "short"), (None, words(80, 78)), (None, "x"), (2, None)]
    table = spark.createDataFrame(rows(texts), SCHEMA).withColumnRenamed("kept", "_kept").repartition(2)
    got = quality.keep(table, labels.limit(0))
    assert got.columns == table.columns
    assert sorted(str(r.doc_id) + r.text for r in got.collect()) == sorted(str(d) + t for d, t in [texts[0], texts[2]])


def test_quality_trees_fall_with_constrained_features():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.FEATURES)))
    k = quality.FEATURES.index("symbol_share")
    y = (x[:, k] + 0.3 * np.sin(20 * x[:, k]) + 0.2 * rng.random(2000) < 0.6).astype(int)
    trees = quality.train(x, y)
    for row in x[:20]:
        line = np.repeat(row[None], 50, axis=0)
        line[:, k] = np.linspace(0, 1, 50)
        assert (np.diff(trees.odds(line)) <= 1e-12).all()


def brute_repeats(texts):
    ordered = sorted(((-(1 << 63) if d is None else d), (t or "").encode()) for d, t in texts)
    first = {}
    for d, b in ordered:
        for i in range(len(b) - 99):
            key = b[i : i + 100]
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = collections.Counter()
    for d, b in ordered:
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] != (d, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out[(None if d == -(1 << 63) else d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(spark, docs, empty, hot):
    small = [(d, t if t is None or len(t) < 50_000 else t[:5000]) for d, t in TEXTS] + [(20, "ab" * 300), (21, "xyz" + "ab" * 200), (22, "q" * 99), (23, "q" * 101)]
    table = spark.createDataFrame(rows(small), SCHEMA).repartition(3)
    assert collections.Counter(map(tuple, suffix.digests(table, hot).collect())) == brute_repeats(small)
    assert suffix.digests(empty).count() == 0


def test_deep_shallow_order():
    rng = np.random.default_rng(3)
    data = rng.choice([97, 98], 600).astype(np.uint8)
    data[200:350] = data[20:170]
    suffixes = np.arange(500)
    order, group = suffix.deep_shallow(data, suffixes, shallow=8)
    strings = [data[i : i + 100].tobytes() for i in order]
    assert strings == sorted(strings)
    assert all((strings[i] == strings[i + 1]) == (group[i] == group[i + 1]) for i in range(len(order) - 1))


def test_blind_trie_orders():
    rng = np.random.default_rng(4)
    strings = list({bytes(rng.choice([1, 2, 3], 12)) for _ in range(200)})
    assert [strings[i] for i in suffix.BlindTrie(strings).order()] == sorted(strings)


def test_mixing(docs, empty):
    got = mixing.taken(docs).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, len(split(t))) for d, t in TEXTS)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs).collect()))
    source = {d: None if (d or 0) % 5 == 0 else f"s{(d or 0) % 3}" for d, _ in TEXTS}
    taken, target = collections.Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 2 * mixing.BLOCK for s, t in target.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(split(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_equals_brute_force(spark):
    texts = [(d, words(n, d)) for d, n in enumerate([900, 10, 0, 700, 5000, 130, 64, 1, 333, 2000])] + [(3, words(200, 90)), (None, words(70, 91)), (4, None)]
    table = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    source = {(r.doc_id, r.text): r.source for r in table.collect()}
    sizes = collections.defaultdict(int)
    for d, t in texts:
        sizes[source[d, t]] += len(split(t))
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    whole, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = whole - sum(2 * sizes[x] for x in capped)
        share = {x: rest * weight[x] / sum(weight[y] for y in names if y not in capped) for x in names if x not in capped}
        over = {x for x, v in share.items() if v > 2 * sizes[x]}
        if not over:
            break
        capped |= over
    target = {x: share.get(x, 2.0 * sizes[x]) for x in names}
    want = collections.Counter()
    for sid, x in enumerate(names):
        docs = sorted(((-1 if d is None else d), spark_hash(spark, t), len(split(t)), d) for d, t in texts if source[d, t] == x)
        owner = [k for k, row in enumerate(docs) for _ in range(row[2])]
        n_blocks = -(-sizes[x] // mixing.BLOCK)
        taken = collections.Counter()
        for slot in range(round(target[x] / sizes[x] * n_blocks) if sizes[x] else 0):
            turn, index = divmod(slot, n_blocks)
            (block,) = mixing.permuted(np.array([index]), n_blocks, mixing.SEED * 1_000_003 + sid * 65_537 + turn)
            taken.update(owner[block * mixing.BLOCK : (block + 1) * mixing.BLOCK])
        for k, (_, _, size, d) in enumerate(docs):
            want[d, size, sizes[x], round(target[x], 6), taken[k]] += 1
    got = collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.taken(table).collect())
    assert got == want


def spark_hash(spark, text):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.xxhash64(F.lit(text).cast("string"))).first()[0]


def test_mixing_takes_clashing_columns(docs):
    clash = docs.selectExpr("doc_id", "text", "source", "n_chars", "doc_id AS sid", "text AS _source", "doc_id AS _tie", "doc_id AS _n", "text AS runs", "doc_id AS row")
    got = mixing.mix(clash)
    assert got.columns == clash.columns
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in got.collect()) == sorted(str((r.doc_id, r.text, r.n_chars)) for r in mixing.mix(docs).collect())


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("b", 10), ("a", 100), (None, 1000), ("c", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 200 and got["b"] == 20 and got["c"] == 0 and got[None] == pytest.approx(1.5 * 1110 - 220)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 100, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))


def test_fingerprints(docs, empty):
    got = minhash.fingerprints(docs).collect()
    ordered = sorted(TEXTS, key=lambda x: ((-1 if x[0] is None else x[0]), "" if x[1] is None else x[1]))
    want = collections.Counter()
    for i, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(t) // 4
        want[(d, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    own = {r.doc_id: r for r in got}
    assert own[0].fingerprint == own[1].fingerprint and own[0].near_next == 1
    assert all(0 <= r.near_edited <= 1 for r in got)
    assert minhash.fingerprints(empty).count() == 0
    assert minhash.fingerprints(docs.where("doc_id = 7")).first().near_next == 1


def test_fingerprints_equal_brute_force(spark):
    """Signatures from sets of word tuples, one hash function and one shingle at a time."""
    base = words(120, 40)
    texts = [(1, base), (2, base.upper()), (3, base.replace(base.split()[7], "other", 1)), (4, "a b"), (5, ""), (6, words(33, 41)), (7, None)]

    def signature(text):
        values = [int(v) for v in minhash.shingles(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]]
        w = split(text.lower())
        assert len(values) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
        return [min(((v * int(m) + int(c)) % 2**64 >> 48 for v in values), default=0xFFFF) for m, c in zip(minhash._MULTIPLY, minhash._ADD)]

    def near(x, y):
        return sum(p == q for p, q in zip(x, y)) / len(x)

    got = {r.doc_id: r for r in minhash.fingerprints(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()}
    for i, (d, t) in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)][1] or ""
        own, changed = signature(t), signature(t[: len(t) - len(t) // 4] + after[: len(t) // 4])
        assert base64.b64decode(got[d].fingerprint) == np.array(own, "<u2").tobytes() and base64.b64decode(got[d].edited_fingerprint) == np.array(changed, "<u2").tobytes()
        assert (got[d].near_edited, got[d].near_next) == (near(own, changed), near(own, signature(after)))


def brute_components(texts):
    def grams(t):
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(d, grams(t)) for d, t in texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = collections.defaultdict(lambda: 1 << 62)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least[find(i)], d)
    return collections.Counter((d, len(s), d if not s else (least[find(i)] if least[find(i)] < 1 << 62 else None)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("find", "block"), [(setsketch.near_duplicates, 1024), (setsketch.near_duplicates, 4), (minhash.near_duplicates, 1024)])
def test_near_duplicates(spark, docs, empty, find, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    near = []
    for k in range(60):  # a hot group of near copies, not all linked with each other
        w = BASE.split()
        for at in rng.integers(0, 300, rng.integers(0, 22)):
            w[at] = f"e{k}x{at}"
        near.append((100 + k, " ".join(w)))
    texts = [*TEXTS, *near]
    table = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    got = find(table).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(texts)
    assert find(empty).count() == 0


def test_keep_one(docs):
    kept = setsketch.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids and 7 not in ids and 8 in ids


def test_keep_one_goes_by_row(spark):
    other = words(80, 61)
    texts = [(1, BASE), (5, words(80, 60)), (5, BASE), (None, other), (None, other.replace(other.split()[79], "z")), (None, ""), (None, BASE)]
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in setsketch.keep_one(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect())
    nulls = [t for d, t in kept if d == -1]
    assert [x for x in kept if x[0] != -1] == [(1, BASE), (5, words(80, 60))]
    assert nulls[0] == "" and len(nulls) == 2 and nulls[1][:60] == other[:60]


def test_setsketch_registers_merge_and_estimate():
    rng = np.random.default_rng(6)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 100))
    one, two, both = (np.unique(np.concatenate(x)) for x in ((shared, a), (shared, b), (shared, a, b)))
    r = [setsketch.registers(x, np.array([0, len(x)])) for x in (one, two, both)]
    assert (setsketch.merge(r[0], r[1]) == r[2]).all()
    got = setsketch.joint_estimate(r[0], r[1], np.array([len(one)]), np.array([len(two)]))[0]
    assert abs(got - 600 / 900) < 0.15


def test_line_dedup(spark, docs, empty):
    line = "This notice number 17 was printed by the office of records today"
    other = "This notice number 99 was printed by the office of archives today"
    texts = [(i, f"{words(50, 50 + i)}\n{line if i % 2 else other}\n{words(50, 90 + i)}") for i in range(8)]
    copies = [(100 + i, words(50, 7) + "\n" + words(50, 8)) for i in range(6)]
    table = spark.createDataFrame(rows(texts + copies), SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in templates.drop(table).collect()}
    for d, t in texts:
        assert got[d] == "\n".join(t.split("\n")[::2])
    for d, t in copies:
        assert got[d] == t
    assert templates.drop(docs).columns == docs.columns
    assert templates.drop(docs).where("doc_id = 3").first().text is None
    assert collections.Counter(r.doc_id for r in templates.digests(docs).collect()) == collections.Counter(d for d, _ in TEXTS)
    shared = {r.doc_id: r.n_dropped for r in templates.digests(docs).collect()}
    assert shared[12] == shared[13] == shared[14] == 1 and shared[8] == 0
    assert templates.digests(empty).count() == 0


def brute_line_dedup(texts):
    """Numbers of the dropped lines by row, from templates as tuples and full sets of shingles."""
    rows, held = [], collections.defaultdict(set)
    for t in texts:
        lines = []
        for x in (t or "").split("\n"):
            w = split(re.sub("[A-Z]", lambda m: m[0].lower(), x))
            n, masked = len(w), ["#" if re.search("[0-9]", v) else v for v in w]
            whole, wild = None, set()
            if n >= 3 and 2 * masked.count("#") <= n:
                whole = tuple(masked)
                part = [i * 6 // n for i in range(n)]
                for gone in [*itertools.combinations(range(6), 2), *(itertools.combinations(range(6), 3) if n >= 9 else [])]:
                    kept = tuple(v for v, p in zip(masked, part) if p not in gone)
                    if n >= 4 and len(kept) >= max(3, 0.4 * n):
                        wild.add((gone, n, kept))
            lines.append((w, whole, wild))
        rows.append(lines)
        for _, whole, _ in lines:
            held[whole].add(t)
    exact = {k for k, ts in held.items() if k and len(ts) >= 3}
    wider = collections.defaultdict(set)
    for lines, t in zip(rows, texts):
        for _, whole, wild in lines:
            for k in wild:
                wider[k].add(whole if whole in exact else None)
                if whole not in exact:
                    held[k].add(t)
    shared = lambda line: ({line[1]} & exact) or {k for k in line[2] if len(held[k]) >= 3 or wider[k] - {None}}
    owners = collections.defaultdict(list)
    for lines, t in zip(rows, texts):
        own, total = [x for x in lines if not shared(x)], sum(len(x[0]) for x in lines)
        if 6 * sum(len(x[0]) for x in own) >= total:
            grams = frozenset(tuple(w[i : i + 5]) for w, _, _ in own for i in range(max(1, len(w) - 4)) if w)
            for k in set().union(*map(shared, lines)):
                owners[k].append(grams)
    recurring = set()
    for k, sets in owners.items():
        classes = []
        for g in sets:
            if not any(2 * len(g & c) >= len(g | c) for c in classes):
                classes.append(g)
        if len(classes) >= 3:
            recurring.add(k)
    recurring |= {k for k, wholes in wider.items() if wholes & recurring}
    return [{i for i, x in enumerate(lines) if shared(x) & recurring} for lines in rows]


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(20)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 16, 6))
    many = lambda n: " ".join(word() for _ in range(n))
    texts = []
    first, second = many(11), many(10)
    texts += [f"{first}\n{many(rng.integers(1, 6))}\n{second}" for _ in range(30)]  # more boilerplate than page
    texts += [f"{many(30)}\nNotice {word()} was printed by the office of records today\n{many(20)}" for _ in range(12)]  # the second token varies
    texts += [f"{many(30)}\nThe notice {word()} was printed by the {word()} office of records and sent out today" for _ in range(12)]  # two fields
    texts += [f"{many(20)}\nprinted by {word()} office of records today\n{many(9)}" for _ in range(12)]  # seven tokens
    texts += [f"{many(30)}\nsold at shop {k % 4} in {['york', 'bonn', 'rome', word()][k % 4]} for money" for k in range(14)]  # some values often, some once
    texts += [f"{many(20)}\nonly two texts hold this line of words" for _ in range(2)] + [f"{many(8)}\ntoo short" for _ in range(5)]
    base = [many(14) for _ in range(8)]
    for k in range(12):  # near copies with one other word, and exact copies
        x = list(base)
        x[k % 8] = " ".join([*x[k % 8].split()[:-1], word()])
        texts += ["\n".join(x)] * (1 + k % 3)
    texts += [f"{many(60)}\n{base[0]}", None, "", "\n\n"]
    df = spark.createDataFrame(rows(list(enumerate(texts))), SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in templates.drop(df).collect()}
    want = brute_line_dedup(texts)
    assert got == {i: templates.without_lines(t, x) for i, (t, x) in enumerate(zip(texts, want))}
    counts = [len(x) for x in want]
    assert sum(counts[:30]) == 60 and all(counts[30:66]) and sum(counts[66:80]) == 14 and not any(counts[80:])
    clash = df.selectExpr("doc_id", "text", "text AS _tie", "doc_id AS tie", "text AS lines", "doc_id AS _lines", "text AS row", "doc_id AS _d", "n_chars")
    assert {r.doc_id: r.text for r in templates.drop(clash).collect()} == got


@pytest.mark.parametrize(("tokens", "fields"), [(3, 0), (4, 1), (6, 1), (8, 1), (8, 2), (12, 2), (12, 3), (20, 3), (30, 3)])
def test_line_dedup_finds_planted_templates(spark, tokens, fields):
    """Of ten templates in six documents each, with fields at random places; lines around them stay."""
    rng = np.random.default_rng(tokens * 10 + fields)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 20, 7))
    many = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for _ in range(10):
        base, places = many(tokens).split(), rng.choice(tokens, fields, replace=False)
        for _ in range(6):
            line = [word() if i in places else w for i, w in enumerate(base)]
            texts.append(f"{many(40)}\n{' '.join(line)}\n{many(35)}")
    got = {r.doc_id: r.text for r in templates.drop(spark.createDataFrame(rows(list(enumerate(texts))), SCHEMA).repartition(3)).collect()}
    assert all(t.split("\n")[0] in got[d] and t.split("\n")[2] in got[d] for d, t in enumerate(texts))
    assert sum(got[d] == "\n".join(t.split("\n")[::2]) for d, t in enumerate(texts)) >= 0.9 * len(texts)


def test_line_dedup_takes_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 9))) for _ in range(400)] + [words(900, 4)]
    for text in ("\n".join(lines[i] for i in rng.integers(0, len(lines), 3000)), "\n\n", words(3000, 1), "a b c d e f\n" * 500, "x y z w v\n" + words(2000, 8) + "\nx y z w v"):
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        monkeypatch.setattr(templates, "PIECE", 1 << 30)
        whole = templates.line_parts(data, offsets)
        for piece in (1, 300, 5000):
            monkeypatch.setattr(templates, "PIECE", piece)
            for x, y in zip(whole, templates.line_parts(data, offsets)):
                assert x.keys() == y.keys() and all((x[k] == y[k]).all() and x[k].shape == y[k].shape for k in x)


@pytest.mark.parametrize("stage", ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"])
def test_stages_with_clashing_columns(spark, docs, tmp_path, stage):
    """Whatever the other columns are called, a stage does the same and carries them along."""
    import corpus_pipeline

    at = str(tmp_path / "sf")
    spark.createDataFrame([(d, 1, d % 4 == 0 and 1 or 0) for d in range(16)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    odd = {"_tie": "text", "tie": "lang", "_d": "text", "_t": "lang", "row": "text", "doc": "lang", "OWN_ID": "lang", "own_text": "text", "node": "lang", "component": "lang", "lines": "text", "score": "lang", "label": "lang", "_bucket": "lang", "size": "lang", "block": "text", "N": "lang", "key": "text"}
    run = dict(corpus_pipeline.STAGES)[stage]
    want, got = run(spark, plain, at), run(spark, plain.withColumns({k: F.col(v) for k, v in odd.items()}), at)
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, got.select(want.columns).collect())) == order(map(tuple, want.collect()))
    if stage in ("toxicity", "line_dedup", "near_dedup"):
        assert got.columns == [*plain.columns, *odd]
        assert all(r["tie"] == r["lang"] and r["OWN_ID"] == r["lang"] for r in got.collect())


def test_line_dedup_counts_documents_that_differ(spark):
    notice, first, second = words(12, 31), words(40, 32), words(40, 33)
    others = [(i, words(60, 200 + i) + "\n" + notice) for i in range(10)]
    copies = [(100 + i, words(60, 300) + "\n" + notice) for i in range(60)]
    both = [(200 + i, first + "\n" + words(50, 400 + i) + "\n" + second) for i in range(4)]
    near = []
    for i in range(40):
        w = BASE.split()
        for at in (7 * i, 7 * i + 3):
            w[at % 150] = f"e{i}x"
        near.append((300 + i, " ".join(w[:150]) + "\n" + " ".join(w[150:])))
    alone = [(400 + i, words(30, 500)) for i in range(5)]
    got = {r.doc_id: r.text for r in templates.drop(spark.createDataFrame(rows(others + copies + both + near + alone), SCHEMA).repartition(3)).collect()}
    assert all(got[d] == t.split("\n")[0] for d, t in others + copies)
    assert all(got[d] == t.split("\n")[1] for d, t in both)
    assert all(got[d] == t for d, t in near + alone)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    at = str(tmp_path / "sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, at)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Every stage on what its predecessor wrote, against brute force; and run() gives what the stages give."""
    import corpus_pipeline
    import tiktoken

    rng = np.random.default_rng(12)
    notice, clean = words(11, 700), [words(60 + i % 20, 800 + i) for i in range(120)]
    texts = [(i, t + (f"\n{notice}" if i % 3 == 0 else "")) for i, t in enumerate(clean)]
    toxic = [(200 + i, words(50, 950 + i) + " grobnax vilethrup zornaq " + words(10, 990 + i)) for i in range(60)]
    near = []
    for k in range(12):
        w = BASE.split()
        for at in rng.integers(0, 300, 4):
            w[at] = f"n{k}x{at}"
        near.append((300 + k, " ".join(w)))
    every = texts + toxic + near + [(400, ""), (401, None), (402, "one two"), (403, "one two"), (None, words(40, 33))]
    at = str(tmp_path / "sf")
    spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 4}", None if t is None else len(t)) for d, t in every], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, int(200 <= d < 300)) for d, _ in texts[:90] + toxic[:45]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs, held = spark.read.parquet(f"{at}/documents.parquet"), [every]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        held.append([(r.doc_id, r.text) for r in docs.collect()] if name != "bpe" else docs.collect())
    _, calm, lined, single, mixed, coded = held
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")

    assert sorted(calm, key=key) == sorted((r for r in every if not (r[0] and 200 <= r[0] < 300)), key=key)
    drops = brute_line_dedup([t for _, t in calm])
    assert sorted(lined, key=key) == sorted(((d, templates.without_lines(t, x)) for (d, t), x in zip(calm, drops)), key=key)
    assert sum(map(len, drops)) == 40
    firsts = {d for (d, _, c), n in brute_components(lined).items() if d == c}
    assert sorted(single, key=key) == sorted((r for r in lined if r[0] in firsts), key=key)
    assert {d for d, _ in single if d and 300 <= d < 400} == {300} and 402 in firsts and 403 not in firsts and None in firsts

    source, whole = lambda d: f"s{(d or 0) % 4}", {d: split(t) for d, t in single}
    size, taken = collections.Counter(), collections.Counter()
    for d, w in whole.items():
        size[source(d)] += len(w)
    for d, t in mixed:
        taken[source(d)] += len(split(t))
        assert " ".join(split(t)) in " ".join(whole[d])
    targets = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
    assert all(abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK for s in size)

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for d, t in mixed:
        ids = encoding.encode_ordinary(t)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded) == want
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, at).select(coded[0].__fields__).collect())) == collections.Counter(map(tuple, coded))
