"""Operators against brute force on small fixtures with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import bpe, chaining, exact_dedup, jaccard_join, kneser_ney, line_dedup, mixing, pivots, toxicity, warc, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, cls string, id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = []
    for i in range(60):
        ws = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 40, 120]))]
        out.append((2 * i, " ".join(ws), "en", f"s{i % 3}"))
        if i % 2:
            near = list(ws)
            near[rng.randrange(len(near))] = "changed"
            out.append((2 * i + 1, rng.choice(["  ", "\t"]).join(near if i % 4 == 1 else ws).upper(), "en", None))
    out += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "one"), (1003, "one"), (None, "one"), (1005, " ".join(vocab * 30), "de", "s9")]
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(n, edges):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_jaccard_components(spark, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()), key=str)
    named = sorted({r[0] for r in rows if r[0] is not None})
    sets = {i: [shingles(r[1]) for r in rows if r[0] == i] for i in named}
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    edges = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(named), 2) if any(near(x, y) for x in sets[a] for y in sets[b])]
    comp = dict(zip(named, (named[i] for i in roots(len(named), edges)), strict=True))
    assert got == sorted(((r[0], len(shingles(r[1])), comp.get(r[0])) for r in rows), key=str)
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_sets_meet_once_and_no_pair_is_lost(spark):
    rng = random.Random(17)
    lists = []
    for family in range(6):
        base = rng.sample(range(1000 * family, 1000 * family + 60), 40)
        for k in range(5):
            n = rng.randint(30, 40)
            # By another doc_id each, and one that holds two sets; the order of the keys is the same in all.
            own = sorted({*rng.sample(base, n - 8), *(1000 * family + 100 + rng.randrange(30) for _ in range(8))})
            lists += [(t, 10 * family + min(k, 3), len(own), len(own) - i) for i, t in enumerate(own)]
    got = jaccard_join._after(spark.createDataFrame(lists, "token long, id long, n int, room int"), 8).collect()
    lists = {}
    for r in got:
        lists.setdefault(r.token, []).append(r)
    fits = lambda x, y: 4 * x.n >= 3 * y.n and 4 * y.n >= 3 * x.n and 7 * min(x.room, y.room) >= 3 * (x.n + y.n)
    met = [(x.id, y.id, not {*x.before} & {*y.before}) for same in lists.values() for x, y in itertools.combinations(sorted(same), 2) if x.id < y.id and fits(x, y)]
    assert {m[:2] for m in met} == {m[:2] for m in met if m[2]}
    assert len(met) > 2 * sum(m[2] for m in met) > 0
    # Subsets of small sets are in no order that other sets follow.
    assert all(not r.before for r in jaccard_join._after(spark.createDataFrame([(t, 1, 8, 8) for t in range(9)], "token long, id long, n int, room int"), 8).collect())


def test_jaccard_components_of_families_of_large_sets(spark):
    rng = random.Random(23)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for family in range(8):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 90, 250]))]
        for k in range(9):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            docs.append((9 * family + k, " ".join(own)))
    rng.shuffle(docs)
    docs.sort(key=lambda d: d[0] % 2)
    sets = [shingles(d[1]) for d in docs]
    want = roots(len(docs), [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    ids: dict = {}
    for d, r in zip(docs, want, strict=True):
        ids[r] = min(ids.get(r, d[0]), d[0])
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, docs)).collect()}
    assert got == {d[0]: ids[r] for d, r in zip(docs, want, strict=True)} and 8 < len(set(got.values())) < len(docs)


def test_exact_dedup(spark, rows):
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()), key=str)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = []
    for r in rows:
        group = [x for x in rows if norm(x[1]) == norm(r[1])]
        keep = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        want.append((r[0], keep, len(group), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    weak = exact_dedup.exact_dedup(frame(spark, rows), digest=lambda norm: F.substring(F.sha2(norm, 256), 1, 1), batches=3)  # texts that clash are told apart by their bytes
    assert sorted((tuple(r)[:4] for r in weak.collect()), key=str) == sorted((w[:4] for w in want), key=str)


def test_exact_dedup_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [(i, hashlib.sha256(str(i % 7).encode()).hexdigest(), 5 + i % 3) for i in range(60)]
    schema = "doc_id long, digest string, code_points long"
    at, out, checkpoint = (str(tmp_path / x) for x in ("digests", "out", "state"))
    for part in (rows[:25], rows[25:]):  # the second run restores the state of the first
        df = spark.createDataFrame(part, schema).repartition(3).select("doc_id", "digest", "code_points", F.lit(1).cast("long").alias("file"), F.col("doc_id").alias("at"))
        df.write.mode("append").parquet(at)
        exact_dedup.dedup_stream(at, df.schema, out, checkpoint, spark)
    got = {r.digest: (r.keep_id, r.at, r.group_size) for r in exact_dedup.last_state(spark, out).collect()}
    for d in {r[1] for r in rows}:
        group = [r for r in rows if r[1] == d]
        keep = min(group, key=lambda r: (-r[2], r[0]))[0]
        assert got[d] == (keep, keep, len(group))
    assert len([x for x in (tmp_path / "out").iterdir() if x.name.startswith("part=")]) >= 4  # three micro-batches, and the empty part


def test_line_dedup(spark):
    texts = [(3, "a\nb\nc\n\nd"), (1, "x\na\nb\nc"), (2, "q\nq\nq\nq"), (4, "b\nc\nz"), (5, None), (None, "c\n\nd"), (6, ""), (4, "solo"), (7, "a\nzz")]
    got = sorted(((r.doc_id, r.text, r.n_lines, max(r.removed_lines, 0)) for r in line_dedup.line_dedup(frame(spark, texts)).collect()), key=str)
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0, i))
    seen, gone = set(), {i: set() for i in order}
    for i in order:
        real = [k for k, x in enumerate((texts[i][1] or "").split("\n")) if x.strip()]
        for a, b in zip(real, real[1:], strict=False):
            key = tuple((texts[i][1] or "").split("\n")[k] for k in (a, b))
            gone[i] |= {a, b} if key in seen else set()
            seen.add(key)
    want = [(d, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]), len((t or "").split("\n")), len(gone[i])) for i, (d, t) in enumerate(texts)]
    assert got == sorted(want, key=str)
    docs = frame(spark, texts).selectExpr("monotonically_increasing_id() AS row", "doc_id", "text")
    runs = {(r.lines, r.start, r.source_start) for r in line_dedup.repeated_runs(docs).collect()}
    assert (3, 0, 1) in runs


def test_bpe_matches_the_library(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    odd = [(2000, "It's DON'T <|endoftext|> ΟΔΟΣ é İ ½ 中文 a\x1cb\x85c"), (2001, "aaaa bbbbbbb 1234 …!!??"), (2002, "<|startoftext|>")]
    mine = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(frame(spark, rows + odd), bpe.tokenizer_path()).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for r in rows + odd:
        e = t.encode(r[1] or "", add_special_tokens=False)
        want.add((r[0], len(e.ids), sha(" ".join(map(str, e.ids))), sha(t.decode(e.ids, skip_special_tokens=False))))
    assert mine == want
    whole = bpe.bpe_round_trip(frame(spark, rows + odd), bpe.tokenizer_path(), whole=True)
    back = bpe.bpe_decode(whole.withColumnRenamed("decoded", "expected"), bpe.tokenizer_path()).collect()
    assert len(back) == len(rows + odd) and all(r.decoded == r.expected == t.decode(r.ids, skip_special_tokens=False) for r in back)
    assert bpe.bpe_round_trip(frame(spark, []), bpe.tokenizer_path()).count() == 0


def test_warc_round_trip(spark):
    big = "ü" * 600
    pages = [(1, "u1", big), (2, "u2", big), (3, None, "small"), (4, "u", "small"), (5, "u5", None), (None, "n", big), (6, "u6", big + "x"), (2, "u2", big)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, sha1 string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        top = max((x for x, _, y in pages if y == h and x is not None), default=None)
        again = len(b) >= 1000 and i is not None and i != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    frames = list(warc.pack([b"one", b"two" * 500]))
    assert list(warc.unpack(b"".join(frames))) == [b"one", b"two" * 500]


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    vecs = [(i, (base[i % 12] + (0.1 * rng.normal(size=16) if i >= 12 else 0)).tolist(), i % 12 % 2) for i in range(60)]
    vecs += [(60, vecs[0][1], 0), (61, None, 0), (62, [0.0] * 16, 0), (63, [float("nan")] * 16, 1), (64, vecs[0][1], None), (65, [None] * 16, 1), (66, [], 1)]
    df = spark.createDataFrame([(*v, "x") for v in vecs], "vec_id long, embedding array<float>, label int, id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.embedding_links(df).collect()}
    good = [(i, np.float32(v).astype(float), y) for i, v, y in vecs if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w, z in good if j != i and z == y and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98} for i, v, y in good}
    found, total = sum(got[i][0] for i in links), sum(map(len, links.values()))
    assert total * 0.9 <= found <= total and all(got[i][0] <= len(links[i]) for i in links)
    assert all(got[i] == (0, i, True) for i in range(61, 67))


def test_embedding_links_of_a_length_without_pivots(spark):
    rng = np.random.default_rng(7)
    rare = rng.normal(size=9)
    vecs = [(i, rng.normal(size=8).tolist(), 0) for i in range(3000)] + [(5000 + i, (rare + 1e-4 * i).tolist(), 0) for i in range(2)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int")
    lengths = pivots.fit(df.selectExpr("cast(embedding as array<double>) AS v"))
    assert 9 not in lengths
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.embedding_links(df).where("vec_id >= 5000").collect()}
    assert got == {5000: (1, 5000), 5001: (1, 5000)}


def test_pipeline_decides_by_row(spark, tmp_path):
    ws = "the cat sat on the mat and the dog ran to the tree while some birds sang".split()
    text = lambda i: " ".join(random.Random(i).choices(ws, k=30))
    good = [(i, text(i), "en", "a", 100) for i in range(40)]
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([*good, (None, text(100), "en", "a", 100), (70, text(101), "en", "a", 100), (70, "ZXQ!! KJW## QQQ%% VVV&&", "en", "a", 100)], schema)
    out = corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()
    assert {r.text for r in out if r.doc_id is None} == {text(100)} and [r.text for r in out if r.doc_id == 70] == [text(101)]
    same = spark.createDataFrame([(5, "a b c d e f", "en", "a", 11)] * 3 + [(None, "x y z", "en", "a", 5)] * 2 + [(6, "a b c d e f", "en", "a", 11)], schema)
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        assert sorted((r.doc_id or 0, r.text) for r in stage(spark, same, "").collect()) == [(0, "x y z"), (5, "a b c d e f")]
    empty = spark.createDataFrame([], schema)
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.mixing_stage, corpus_pipeline.token_stage):
        assert stage(spark, empty, "").count() == 0
    assert corpus_pipeline.quality_stage(spark, empty, str(tmp_path)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b " * 9000, "en", "a", 36000), (3, "a b " * 9000, "en", "a", 36000), (4, "c d", "de", None, 3)], schema)
    assert sorted(r.doc_id for r in corpus_pipeline.exact_stage(spark, blank, "").collect()) == [1, 3, 4]  # null and empty texts are equal
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, blank, "").collect()) == [1, 2, 3, 4]
    four = spark.createDataFrame([(5, f"w{i} b c d", "en", "a", 8) for i in range(4)], schema)
    mixed = [r.text for r in corpus_pipeline.mixing_stage(spark, four, "").collect()]
    assert len(mixed) == 6 and all(mixed.count(t) <= 2 for t in mixed)


def test_a_stage_of_the_pipeline_shrinks_the_executors_first(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    spark.sparkContext.setJobGroup("stage-start", "")
    corpus_pipeline.token_stage(spark, docs, "")  # its result is not asked for: no other job
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("stage-start")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) >= 1
    stage = spark.sparkContext.statusTracker().getStageInfo(spark.sparkContext.statusTracker().getJobInfo(jobs[0]).stageIds[0])
    assert stage.numTasks == spark.sparkContext.defaultParallelism


def test_mixing(spark, rows):
    out, aims = mixing.mix(frame(spark, rows))
    got, aims = out.collect(), {r.source: (r.source_size, r.target) for r in aims.collect()}
    sizes = {}
    for r in rows:
        s = r[3] if len(r) > 3 else None
        sizes[s] = sizes.get(s, 0) + len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, weight, target = 1.5 * sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}
    free = list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    for s in order:
        assert aims[s][0] == sizes[s] and abs(aims[s][1] - target[s]) < 1e-6
        taken = sum(r.taken for r in got if r.source == s)
        # Copies are whole: a source of one document misses its target by at most half of that document.
        least = min(len((r[1] or "").split()) or 10**9 for r in rows if (r[3] if len(r) > 3 else None) == s)
        assert abs(taken - target[s]) <= max(5, 0.02 * target[s], least / 2)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert all(r.copies == 0 for r in got if r.size == 0)
    blank = mixing.mix(frame(spark, [(i, None, "en", "s") for i in range(5)] + [(9, "a b c", "en", "s"), (10, None, "en", "t")]))[0].collect()
    assert {r.doc_id: r.copies for r in blank if r.size == 0} == dict.fromkeys([*range(5), 10], 0)
    assert mixing.mix(frame(spark, []))[0].count() == 0
    again = mixing.mix(frame(spark, rows))[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def plain_kneser_ney(texts, order):
    """The model as a function of (context, byte), from dictionaries."""
    levels = {order: {}}
    for t in texts:
        x = b"\0" * (order - 1) + t
        for i in range(len(t)):
            g = x[i : i + order]
            levels[order][g] = levels[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    taken, contexts = {}, {}
    for k, grams in levels.items():
        r = [sum(n == i for n in grams.values()) for i in range(5)]
        y = r[1] / max(r[1] + 2 * r[2], 1)
        taken[k] = [0, *(min(max(i - (i + 1) * y * r[i + 1] / max(r[i], 1), 0.1 * i), 0.95 * i) for i in (1, 2, 3))]
        contexts[k] = {}
        for g, n in grams.items():
            total, off = contexts[k].get(g[:-1], (0, 0))
            contexts[k][g[:-1]] = total + n, off + taken[k][min(n, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        total, off = contexts[k].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        n = levels[k].get(g, 0)
        return (n - taken[k][min(n, 3)]) / total + off / total * p(g[1:])

    return p


def test_perplexity_against_a_plain_model(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 40)))
    docs = [(i, text(), rng.choice(["en", "de"])) for i in range(80)] + [(200, None, "en"), (201, " \n ", "en"), (202, "a\0b unseen ÿ", "en"), (None, "abc abc", "en"), (203, "any", "xx"), (204, "abc", None), (5, "abc de", "en"), (205, text() * 300, "en")]
    labels = spark.createDataFrame([(i, 1, "x") for i in range(60)] + [(3, 0, "x"), (70, 0, "x"), (None, 1, "x")], "doc_id long, quality int, lang string")
    frame(spark, docs).repartition(3).write.parquet(str(tmp_path / "d"))  # several splits
    stored = spark.read.parquet(str(tmp_path / "d"))
    halves = {r.i: r.h for r in spark.range(60).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("h")).collect()}
    good = lambda h, g: [kneser_ney.plain(t) for i, t, y in docs if i in halves and (y or "") == g and (h is None or halves[i] == h)]
    plain = {(h, g): plain_kneser_ney(good(h, g), kneser_ney.ORDER) for h in (0, 1, None) for g in ("en", "de")}
    for source in (stored, frame(spark, docs)):  # read from files, and not
        got = sorted(((r.doc_id, r.lang, r.n_bytes, r.perplexity) for r in kneser_ney.quality(source, labels).collect()), key=str)
        want = []
        for i, t, g in docs:
            x = kneser_ney.plain(t)
            p = plain.get((1 - halves[i] if i in halves else None, g or ""), lambda _: 1 / 256)
            full = b"\0" * (kneser_ney.ORDER - 1) + x
            logp = sum(np.log(p(full[k : k + kneser_ney.ORDER])) for k in range(len(x)))
            want.append((i, g, len(x), float(np.exp(-logp / len(x))) if x else None))
        assert len(got) == len(want)
        for a, b in zip(got, sorted(want, key=str), strict=True):
            assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 1e-4 * b[3])
    p = plain[(None, "en")]
    for context in (b"\0\0\0\0", b"abc ", b"zzzz"):  # probabilities of whatever may follow a context sum to one
        assert abs(sum(p(context + bytes([c])) for c in range(256)) - 1) < 1e-9
    assert kneser_ney.quality(stored.limit(0), labels).count() == 0 and kneser_ney.quality(frame(spark, []), labels.limit(0)).count() == 0


def test_quality_rejects_junk(spark):
    good = [(i, "the cat sat on the mat and the dog ran to the tree " * 3, "en") for i in range(20)]
    bad = [(100, "ZXQ!! KJW## QQQ%% VVV&& XZX", "en"), (101, None, "en"), (102, "anything", "xx"), (103, "the dog sat on the mat", None)]
    labels = spark.createDataFrame([(i, 1, 0, "t") for i in range(20)] + [(100, 0, 0, "t"), (0, 1, 0, "t")], "doc_id long, quality int, toxic int, text string")
    kept = {r.doc_id: r.kept for r in kneser_ney.quality(frame(spark, good + bad), labels).collect()}
    assert all(kept[i] for i in range(20)) and not kept[100] and not kept[101] and kept[102]


def test_each_pass_of_the_quality_model_shrinks_the_executors_first(spark, monkeypatch):
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    docs = frame(spark, [(i, f"the cat sat on the mat {i}", "en") for i in range(12)])
    order, stored, shrink = [], kneser_ney.stored, kneser_ney.shrink_executors
    monkeypatch.setattr(kneser_ney, "stored", lambda df, name, **k: order.append(name) or stored(df, name, **k))
    monkeypatch.setattr(kneser_ney, "shrink_executors", lambda s: order.append("shrink") or shrink(s))
    assert kneser_ney.quality(docs, labels).count() == 12
    assert all(order[order.index(name) - 1] == "shrink" for name in ("kn-keys", "kn-answers", "kn-scores"))


def test_kneser_ney_sees_word_order_and_repetition(spark):
    rng = random.Random(8)
    pick = lambda *ws: rng.choice(ws)
    sentence = lambda: f"the {pick('old', 'small', 'red')} {pick('cat', 'dog', 'bird')} {pick('sat', 'slept', 'sang')} on the {pick('mat', 'tree', 'roof')} with a {pick('friend', 'hat', 'song')} ."
    text = lambda: " ".join(sentence() for _ in range(12))
    good = [(i, text(), "en") for i in range(80)]
    shuffled = text().split()
    rng.shuffle(shuffled)
    other = [(100, " ".join(shuffled), "en"), (101, "the " * 100, "en"), (102, " ".join(f"{w} " * 30 for w in ("cat", "on", "mat")), "en"), (103, text(), "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.quality(frame(spark, good + other), labels).collect()}
    assert [got[i].kept for i in range(100, 104)] == [False, False, False, True]
    assert got[100].perplexity > 2 * got[103].perplexity


def test_toxicity(spark):
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(50)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        ws = [rng.choice(filler) for _ in range(30)] + (["vileword", "muslim"] if bad else ["muslim"] if i % 7 == 0 else [])
        docs.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad), "x"))
    docs += [(500, None), (501, ""), (None, "vileword"), (502, "christian people came to the town")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    keys, weights = toxicity.train(frame(spark, docs), lab)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, docs), keys, weights).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400) if toxicity.held_out(i))
    assert got[500].score == got[501].score < 0.5 and got[502].predicted == 0
    assert toxicity.train(frame(spark, docs), lab.limit(0))[0].size == 0


def test_swaps_stay_in_a_language_and_category():
    near = lambda t: [x.decode() for x in toxicity.swaps(t.lower().encode())]
    assert near("a gay man, and two women.") == ["a lesbian girl, and two men.", "a straight boy, and two girls."]
    assert near("eine FRAU kam") == ["eine mann kam"] and near("la femme est là") == ["la homme est là"]
    assert near("nothing here") == [] and toxicity.swaps(b"") == []
    assert toxicity.swaps("JÜDISCH oder".encode()) == ["muslimisch oder".encode(), "christlich oder".encode()]


def test_the_penalty_lowers_the_weight_of_identity_terms(spark):
    rng = random.Random(11)
    filler = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        ws = [rng.choice(filler) for _ in range(25)]
        # Toxic rows mention one group far more often than others do, and carry one of two vile words.
        ws += ["muslim"] * (rng.random() < (0.8 if bad else 0.05)) + ["christian"] * (rng.random() < 0.3) + ([rng.choice(["vileword", "foulword"])] if bad and rng.random() < 0.8 else [])
        rng.shuffle(ws)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [(1000 + i, " ".join([*(rng.choice(filler) for _ in range(25)), "muslim"])) for i in range(60)]
    swapped = [(2000 + i, t.replace("muslim", "christian")) for i, (_, t) in enumerate(neutral)]
    score = {}
    for swap in (0.0, 2.0):
        got = {r.doc_id: r.score for r in toxicity.score(frame(spark, neutral + swapped), *toxicity.train(frame(spark, docs), lab, swap=swap)).collect()}
        score[swap] = np.array([[got[1000 + i], got[2000 + i]] for i in range(60)])
    change = {k: np.abs(v[:, 0] - v[:, 1]).mean() for k, v in score.items()}
    false = {k: (v[:, 0] >= 0.5).mean() for k, v in score.items()}
    assert change[2.0] < 0.25 * change[0.0] and false[2.0] <= false[0.0] and score[2.0][:, 0].mean() < score[0.0][:, 0].mean()


def test_passages(spark):
    rng = random.Random(2)
    fresh = lambda n: [f"{rng.randrange(10**6):x}" for _ in range(n)]
    shared = fresh(70)
    fuzzy = list(shared)
    fuzzy[30] = "other"
    docs = [(1, " ".join(fresh(40) + shared + fresh(30))), (2, " ".join(fresh(90) + shared)), (3, " ".join(fuzzy + fresh(50))), (4, " ".join(fresh(200))), (5, " ".join(shared[:20] + fresh(80))), (6, None), (7, ""), (None, " ".join(shared))]
    docs.append((8, docs[0][1].upper()))
    got = chaining.passages(frame(spark, docs)).collect()
    assert {r.doc_id for r in got if r.kind == "passage"} == {2, 3} and [(r.doc_id, r.first_doc_id) for r in got if r.kind == "copy"] == [(8, 1)]
    two = next(r for r in got if r.doc_id == 2 and r.first_doc_id == 1)
    assert (two.start, two.end, two.first_start, two.first_end) == (90, 160, 40, 110)


def test_passages_with_many_changes_and_a_second_copy(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"{rng.randrange(10**6):x}" for _ in range(n)]
    docs, changed = [], {}
    for i in range(20):
        shared = fresh(60)
        for k, every in enumerate((6, 8, 10)):  # pairs of their own, similarity 0.83, 0.88 and 0.90
            base = 100 * i + 10 * k
            other = [w if (j + 3) % every else f"changed{j}" for j, w in enumerate(shared)]
            mine = [f"{w}.{k}" for w in shared]
            docs += [(base, " ".join(fresh(30) + mine + fresh(30))), (base + 1, " ".join(fresh(45) + [w if w.startswith("changed") else f"{w}.{k}" for w in other] + fresh(20)))]
            changed.setdefault(every, []).append(base + 1)
    twice = fresh(60)
    docs += [(9000, " ".join(twice)), (9001, " ".join(fresh(20) + twice + fresh(90) + twice))]
    got = [(r.doc_id, r.start) for r in chaining.passages(frame(spark, docs)).collect()]
    for ids in changed.values():
        assert len(set(ids) & {d for d, _ in got}) == len(ids)
    assert sorted(s for d, s in got if d == 9001) == [20, 170]


def test_passages_meet_a_whole_copy_behind_partial_ones(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"{rng.randrange(10**6):x}" for _ in range(n)]
    p = fresh(70)
    parts = {1: p[:40], 2: p[30:], 3: p, 4: p[:40], 5: p[30:], 6: p}
    docs = [(i, " ".join(fresh(30) + part + fresh(30))) for i, part in parts.items()]
    got = {(r.doc_id, r.first_doc_id, r.start, r.end) for r in chaining.passages(frame(spark, docs)).collect()}
    assert (6, 3, 30, 100) in got


def test_passages_meet_any_document_behind_partial_ones(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"{rng.randrange(10**6):x}" for _ in range(n)]
    docs, wanted = [], set()
    for base, every in ((0, 12), (100, 9), (200, 1000)):
        p = fresh(72)
        # Before and behind the whole copy, documents that have any seed of the passage, but no piece that makes one.
        pieces = [p[k : k + 26] for k in range(0, 72, 21)]
        if every > 72:  # equal words: the longest seeds have other documents too
            pieces += [p[k : k + 49] for k in range(0, 24)]
        other = [w if (k + 3) % every else f"other{k}" for k, w in enumerate(p)]
        texts = [*pieces, p, *pieces, other]
        docs += [(base + i, " ".join(fresh(70) + t + fresh(70))) for i, t in enumerate(texts)]
        wanted.add((base + len(texts) - 1, base + len(pieces)))
    got = {(r.doc_id, r.first_doc_id): (r.start, r.end) for r in chaining.passages(frame(spark, docs)).collect()}
    assert wanted <= got.keys() and all(got[w][0] <= 72 and got[w][1] >= 138 for w in wanted)


def test_chains_of_many_anchors_at_few_places():
    rng = random.Random(15)
    x, y = [rng.randrange(3) * 30 for _ in range(400)], [rng.randrange(3000) for _ in range(400)]
    n = [rng.randint(5, 30) for _ in range(400)]
    best = {}
    for i in sorted(range(400), key=lambda i: (x[i], y[i])):
        best[i] = float(n[i])
        for j in best:
            gx, gy = x[i] - x[j] - n[j], y[i] - y[j] - n[j]
            over = max(0, -gx, -gy)
            if x[j] < x[i] and y[j] < y[i] and max(gx, gy) <= chaining.BREAK and over < n[i]:
                best[i] = max(best[i], n[i] + best[j] - chaining.GAP * abs(gx - gy) - chaining.SKIP * max(0, gx) - over)
    for worth, path in chaining.scored(x, y, n):
        assert abs(worth - best[path[-1]]) < 1e-9


def test_parts_of_matches_hold_their_chains():
    rng = np.random.default_rng(5)
    for _ in range(200):
        m = int(rng.integers(2, 40))
        x, y = rng.integers(0, 600, m), rng.integers(0, 600, m)
        n = np.full(m, 5)
        at, part = chaining.parted(np.zeros(m, np.int64), x, y, n)
        where = dict(zip(at.tolist(), part.tolist(), strict=True))
        for path in chaining.chains(x.tolist(), y.tolist()):
            if min(x[path[-1]] - x[path[0]], y[path[-1]] - y[path[0]]) + 5 >= chaining.TELLS:
                assert len({where[k] for k in path}) == 1


def test_couples_against_brute_force():
    rng = np.random.default_rng(6)
    doc = np.sort(rng.integers(0, 5, 200))
    pos = np.concatenate([np.sort(rng.choice(400, (doc == d).sum(), replace=False)) for d in range(5)])
    h = np.arange(200, dtype=np.int64)  # no seed comes twice
    i, j, _ = chaining.couples(doc, pos, h)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(200) for b in range(200) if doc[a] == doc[b] and chaining.NEAR <= pos[b] - pos[a] < chaining.FAR}
    doc, pos, h = np.repeat([0, 1], 50), np.concatenate((np.arange(0, 500, 10), np.arange(7, 507, 10))), np.tile(np.arange(50), 2)
    i, _, content = chaining.couples(doc, pos, h)
    assert (content[doc[i] == 0] == content[doc[i] == 1]).all()  # the same seeds at the same distances


def test_passages_against_brute_force(spark):
    rng = random.Random(12)
    vocab = [f"{rng.randrange(10**6):x}" for _ in range(3000)]
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, planted = {i: fresh(rng.randint(60, 200)) for i in range(120)}, []
    for k in range(30):
        p = fresh(rng.randint(55, 90))
        homes = sorted(rng.sample(range(120), 3))
        for j, i in enumerate(homes):
            mine = list(p)
            for c in range(0 if j < 2 else len(p) // 12):  # the third copy is a fuzzy one
                mine[rng.randrange(len(mine))] = f"c{c}"
            at = rng.randrange(len(docs[i]))
            docs[i] = docs[i][:at] + mine + docs[i][at:]
            if j:
                planted.append((i, mine[5:-5], j == 2))
        for i in rng.sample(range(120), 14):  # decoys: pieces of the passage in many other documents
            at = rng.randrange(len(p) - 26)
            docs[i] = docs[i] + fresh(3) + p[at : at + rng.randint(16, 26)]
    got = [r for r in chaining.passages(frame(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect() if r.kind == "passage"]
    for r in got:  # what is reported is so, by the full longest common subsequence
        a, b = docs[r.doc_id][r.start : r.end], docs[r.first_doc_id][r.first_start : r.first_end]
        row = [0] * (len(b) + 1)
        for w in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, old=tuple(row), w=w: old[j - 1] + 1 if b[j - 1] == w else max(left, old[j]), initial=0))
        assert r.first_doc_id < r.doc_id and max(len(a), len(b)) >= chaining.LEAST_WORDS and row[-1] >= chaining.LEAST_SIMILARITY * max(len(a), len(b))
    caught = {True: [], False: []}
    for i, core, fuzzy in planted:
        at = [k for k in range(len(docs[i])) if docs[i][k : k + len(core)] == core]
        # A later insertion may have cut a planted copy; such a one is no case.
        if at:
            spans = [(r.start, r.end) for r in got if r.doc_id == i]
            caught[fuzzy].append(any(s <= at[0] + len(core) // 2 < e and min(e, at[0] + len(core)) - max(s, at[0]) >= 0.75 * len(core) for s, e in spans))
    assert len(caught[False]) > 15 and np.mean(caught[False]) >= 0.95 and np.mean(caught[True]) >= 0.9
    assert chaining.passages(frame(spark, [])).count() == 0


def test_passages_of_repeated_words_nulls_and_a_long_text(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"{rng.randrange(10**6):x}" for _ in range(n)]
    p = fresh(80)
    docs = [(1, "the " * 300), (2, "the " * 280 + "end"), (3, None), (4, " "), (None, " ".join(p)), (5, " ".join(fresh(15000) + p)), (6, " ".join(p)), (6, " ".join(p)), (7, "the " * 300)]
    got = {(r.doc_id, r.first_doc_id, r.kind) for r in chaining.passages(frame(spark, docs)).collect()}
    assert (2, 1, "passage") in got and (6, 5, "passage") in got and (7, 1, "copy") in got and not {d for d, _, _ in got} & {3, 4, None}


def test_chains_against_dynamic_programming():
    rng = random.Random(14)
    for _ in range(200):
        m = rng.randint(1, 25)
        x, y = [rng.randrange(150) for _ in range(m)], [rng.randrange(150) for _ in range(m)]
        n = [rng.randint(5, 20) for _ in range(m)]
        order = sorted(range(m), key=lambda i: (x[i], y[i]))
        best = {}
        for i in order:
            best[i] = n[i]
            for j in order:
                if j not in best or j == i or x[j] >= x[i] or y[j] >= y[i]:
                    continue
                gx, gy = x[i] - x[j] - n[j], y[i] - y[j] - n[j]
                over = max(0, -gx, -gy)
                if max(gx, gy) <= chaining.BREAK and over < n[i]:
                    best[i] = max(best[i], n[i] + best[j] - chaining.GAP * abs(gx - gy) - chaining.SKIP * max(0, gx) - over)
        path = chaining.chains(x, y, n)[0]
        total = n[path[0]]
        for j, i in itertools.pairwise(path):
            gx, gy = x[i] - x[j] - n[j], y[i] - y[j] - n[j]
            total += n[i] - chaining.GAP * abs(gx - gy) - chaining.SKIP * max(0, gx) - max(0, -gx, -gy)
        assert abs(total - max(best.values())) < 1e-9


def test_chains_prefer_one_diagonal():
    x = [0, 10, 20, 30, 12]
    y = [5, 15, 25, 35, 2]
    assert chaining.chains(x, y)[0] == [0, 1, 2, 3]


def test_chains_of_later_passages_at_the_same_offset():
    x = [*range(0, 200, 5), *range(300, 380, 5), *range(500, 560, 5)]
    assert sorted(map(len, chaining.chains(x, x))) == [12, 16, 40]
    y = [a + (1000 if a < 200 else 500) for a in x]  # a far match on another diagonal comes first
    assert sorted(map(len, chaining.chains([*x, 290], [*y, 5000]))) == [1, 12, 16, 40]


def test_hashes_do_not_depend_on_the_block():
    a, b = words.Words([b"x y z"]), words.Words([b"long text before", b"", b"x y z"])
    assert a.word_hashes().tolist() == b.word_hashes().tolist()[-3:]
