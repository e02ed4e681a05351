"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graintable.llm import components, decontaminate, language, line_dedup, neighbours, pieces, quality, rans, secrets, simhash, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty texts, repeated rows, a very long text, and columns with names that operators use inside."""
    rows = [(None, "no id here", "x", 1, "q"), (1, None, "x", 1, "q"), (2, "", "x", 1, "q"), (3, "same words here", "x", 1, "q"), (3, "same words here", "x", 1, "q"),
            (4, "lang word " * 60_000, "x", 1, "q"), (5, "ab" * 30_000, None, 1, None), (6, " \t\n ", "x", None, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block int, source string").withColumns(
        {c: F.lit(1) for c in ("_id", "_t", "_gone", "_row", "fp", "leaf", "pos", "line", "start", "score", "label", "features", "n_lines_", "tox_score", "quality_score", "lang_pred", "text_", "_y")})


# -- token files

def expected_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(rans.default_tokenizer())
    return [np.array([*e.ids, 0], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files_equal_the_tokenizer(spark, docs):
    rows = {r.doc_id: r for r in rans.op1_token_ids(spark, DATA).collect()}
    source = docs.select("doc_id", "text").orderBy("doc_id").collect()
    at = 0
    for r, ids in zip(source, expected_ids([r.text for r in source]), strict=True):
        assert (rows[r.doc_id].start, rows[r.doc_id].n_tokens, rows[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(source)


def test_cached_cuts_equal_whole_texts():
    texts = ["a b", " lead", "trail ", "two  spaces", "line\nend", "line \nend", "line\n end", "tab\tx", "\n", "", "it's 12 o'clock!\nOK", "é ü x", "<|endoftext|> x", "a\n\nb", "\x1cx y", "x\n",
             "hello <|endoftext|> x", "x\n\n<|endoftext|>\n\ny", "<|endoftext|>", "a \0bc", "\0x y", "a \0 b", "a\n \n\n b", "a \n", " \n a", "\n\n", "  ", "a\u00a0 b", "a \u3000\n b", "a\r\nb c", "a\t b", "don't we'll x's", "1 234 5a b6", "é中文 e\u0301 x", "😀 😀"]
    got = rans.CachedTokenizer(rans.default_tokenizer()).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e[:-1].tolist() for e in expected_ids(texts)]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 100_000])
def test_rans_round_trip_and_partial_decoding(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.001, n) - 1, 60_000).astype(np.uint16)
    counts = np.bincount(ids, minlength=65536)
    table = rans.quantise(counts)
    assert int(table.freq.sum()) == 1 << 20
    assert (table.freq[counts > 0] > 0).all()
    data = rans.encode_block(ids, np.array([n]), table)
    block = rans.Block(data)
    assert (block.decode(table) == ids).all()
    if n:
        parts = [block.run(i, table) for i in range(len(block.positions))]
        assert (np.concatenate(parts) == ids).all()
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.Block(bytes(broken))


def test_quantise_when_all_ids_are_rare():
    counts = np.ones(65536, dtype=np.int64)
    counts[7] = 10**9
    table = rans.quantise(counts)
    assert int(table.freq.sum()) == 1 << 20 and int(table.freq.min()) >= 1


def test_token_files_of_odd_rows(spark, odd):
    folder = rans.new_path(spark, "t")
    rans.write_ids(odd, folder)
    rows = rans.read_ids(spark, folder).orderBy("start").collect()
    assert len(rows) == odd.count()
    assert rows[0].doc_id is None
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert next(r for r in rows if r.doc_id == 2).n_tokens == 1
    empty = rans.new_path(spark, "t")
    rans.write_ids(odd.limit(0), empty)
    assert rans.read_ids(spark, empty).count() == 0


# -- SimHash

def plain_fingerprint(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, docs):
    rows = simhash.op9_simhash(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    assert {r.doc_id: r.component_id for r in rows} == plain_components(ids, [(ids[i], ids[j]) for i, j in near])


def test_close_pairs_find_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = list(base)
    for f in base[:120]:
        for _ in range(3):
            g = int(f)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                g ^= 1 << int(b)
            fps.append(np.uint64(g))
    fps = np.unique(np.array(fps, dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r.u, r.v) for r in simhash.close_pairs(df).collect()]
    signed = fps.view(np.int64)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = plain_components(signed.tolist(), [(int(signed[i]), int(signed[j])) for i, j in near])
    assert plain_components(signed.tolist(), links) == want
    for u, v in links:
        assert want[u] == want[v]


def test_close_pairs_of_large_buckets(spark):
    """Thousands of fingerprints that differ in 16 bits only: all in one bucket of most parts."""
    rng = np.random.default_rng(6)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 16, 1500, dtype=np.uint64) | np.uint64(0xABCD << 16), rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    signed = fps.view(np.int64)
    links = [(r.u, r.v) for r in simhash.close_pairs(spark.createDataFrame([(int(x),) for x in signed], "fp long")).collect()]
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = plain_components(signed.tolist(), [(int(signed[i]), int(signed[j])) for i, j in near])
    assert plain_components(signed.tolist(), links) == want
    assert len(links) < 40 * len(fps)


def test_thresholds_cover_every_pair():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (10**3, 10**6, 10**9):
        parts, t = simhash.plan_search(sample, n, 3)
        assert sum(t) == 3 - len(parts) + 1
        assert sorted(b for p in parts for b in p) == list(range(64))


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 6)} == {1}
    assert next(r for r in rows if r.doc_id is None).component_id is None
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.vertex: r.root for r in components.connected_components(edges).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


# -- line dedup

def test_line_dedup_small_case(spark):
    long = "the quick brown fox number 17 jumps over the lazy dog today"
    rows = [(1, f"own one\n{long}\nlast"), (2, f"own two\n{long.replace('17', '23')}"), (3, f"own three\n{long.replace('lazy', 'tired')}"), (4, "quite another line of text"), (5, None), (6, "")]
    got = {r.doc_id: (r.text, r.n_lines_, r.n_dropped_) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 3, 0), 2: ("own two", 2, 1), 3: ("own three", 2, 1), 4: (rows[3][1], 1, 0), 5: (None, 0, 0), 6: ("", 1, 0)}


def brute_lines(rows, similarity=0.8, lead=3, least=5):
    import re
    from collections import defaultdict

    docs_of = defaultdict(set)
    masked_of = {}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            m = " ".join("<*>" if re.search("[0-9]", t) else t for t in line.lower().split())
            if m:
                docs_of[m].add(i)
                masked_of[i, pos] = m
    leaves = defaultdict(list)
    for m in docs_of:
        leaves[len(m.split()), tuple(m.split()[:lead])].append(m)
    groups = {}
    for (n, _), members in leaves.items():
        if n < least or len(members) < 2:
            continue
        most = max(len(docs_of[m]) for m in members)
        leaders = [m for m in members if len(docs_of[m]) == most]
        groups[tuple(sorted(members))] = leaders
    return docs_of, masked_of, groups


def test_line_dedup_exact_lines_equal_brute_force(spark, docs):
    """With similarity over 1 every masked line is its own template."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    docs_of, masked_of, _ = brute_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs.select("doc_id", "text"), similarity=1.1).collect()}
    for i, text in rows:
        kept = [line for pos, line in enumerate(text.split("\n")) if (m := masked_of.get((i, pos))) is None or len(docs_of[m]) < 2 or min(docs_of[m]) == i]
        assert got[i] == "\n".join(kept)


def brute_tree(lines, similarity=0.8, least=5):
    """Leader of each masked line; lines: {masked: (leaf, docs, k1, k2)}."""
    leads = {}
    of = {}
    for m, (leaf, *_) in sorted(lines.items(), key=lambda x: x[1][1:], reverse=True):
        words = m.split(" ")
        same = (x for x in leads.setdefault(leaf, []) if sum(a == b for a, b in zip(x.split(" "), words)) >= similarity * len(words))
        of[m] = next(same, m) if len(words) >= least else m
        if of[m] == m:
            leads[leaf].append(m)
    return of


@pytest.mark.parametrize("few", [0, line_dedup.FEW_PAIRS])
def test_line_dedup_equals_brute_force_tree(spark, few, monkeypatch):
    """Several template families in a leaf, chains of lines that agree with neighbours only, and lines of all lengths."""
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", few)
    monkeypatch.setattr(line_dedup, "BATCH", 3)
    monkeypatch.setattr(line_dedup, "GROWTH", 2)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        text = []
        for _ in range(6):
            n, family = int(rng.integers(4, 14)), int(rng.integers(0, 4))
            words = ["we", "saw", "the", *(f"{'abcd'[family]}{'xyz'[k % 3]}" for k in range(n - 3))]
            for k in rng.integers(3, n, 2):
                words[k] = str(rng.choice(["red", "blue", "green", words[k], words[k]]))
            text.append(" ".join(words[:n]))
        rows.append((i, "\n".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.template_lines(frame, "doc_id", "text", 3).groupBy("masked", "leaf", "k1", "k2").agg(F.countDistinct("_id").alias("docs")).collect()
    of = brute_tree({r.masked: (r.leaf, r.docs, r.k1, r.k2) for r in found})
    docs_of = {}
    for i, text in rows:
        for line in text.split("\n"):
            docs_of.setdefault(of[line], set()).add(i)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    for i, text in rows:
        assert got[i] == "\n".join(x for x in text.split("\n") if len(docs_of[of[x]]) < 2 or min(docs_of[of[x]]) == i)


def test_line_dedup_equals_brute_force_tree_on_documents(spark, docs):
    """Whole documents at the default similarity."""
    found = line_dedup.template_lines(docs, "doc_id", "text", 3)
    lines = found.groupBy("masked", "leaf", "k1", "k2").agg(F.countDistinct("_id").alias("docs")).collect()
    of = brute_tree({r.masked: (r.leaf, r.docs, r.k1, r.k2) for r in lines})
    at = {(r._id, r.pos): r.masked for r in found.select("_id", "pos", "masked").collect()}
    docs_of = {}
    for (i, _), m in at.items():
        docs_of.setdefault(of[m], set()).add(i)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()}
    for r in docs.select("doc_id", "text").collect():
        kept = [x for pos, x in enumerate(r.text.split("\n")) if (m := at.get((r.doc_id, pos))) is None or len(docs_of[of[m]]) < 2 or min(docs_of[of[m]]) == r.doc_id]
        assert got[r.doc_id] == "\n".join(kept)


def test_line_dedup_second_family_of_a_leaf(spark):
    """The leaf's leading line is another one; the two lines below agree with each other only."""
    lead = "we saw the one two three four five six seven"
    rows = [(1, lead), (2, lead), (3, "we saw the red green blue grey pink teal gold"), (4, "we saw the red green blue grey pink teal lime")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: lead, 2: "", 3: rows[2][1], 4: ""}


def test_line_dedup_settles_a_crowded_leaf(spark, monkeypatch):
    """3,000 lines of one leaf that share most tokens, some families of them within each other's reach: few tables are written, with the tree's result."""
    rng = np.random.default_rng(9)
    base = "we saw the same long line of plain words that every one of them has got in it".split()
    lines = []
    for i in range(2700):  # no two of them agree: four positions of 18 are their own
        words = list(base)
        for at in (14, 15, 16, 17):
            words[at] = "".join(chr(97 + x) for x in rng.integers(0, 26, 9))
        lines.append(" ".join(words))
    for i in range(300):  # variants of six lines
        words = lines[i % 6].split()
        words[int(rng.integers(3, 18))] = f"v{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 60]}"
        lines.append(" ".join(words))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    written, put = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, tag: written.append(tag) or put(df, tag))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert 1 <= written.count("line-top") < 6
    found = line_dedup.template_lines(frame, "doc_id", "text", 3).groupBy("masked", "leaf", "k1", "k2").agg(F.countDistinct("_id").alias("docs")).collect()
    of = brute_tree({r.masked: (r.leaf, r.docs, r.k1, r.k2) for r in found})
    docs_of = {}
    for i, x in enumerate(lines):
        docs_of.setdefault(of[x], set()).add(i)
    assert got == {i: x if min(docs_of[of[x]]) == i else "" for i, x in enumerate(lines)}


def test_line_dedup_odd_rows(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert set(out.columns) == set(odd.columns) | {"n_lines_", "n_dropped_"}
    assert out.count() == odd.count()
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_is_native(spark, docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- toxicity

def test_toxicity_held_out(spark):
    rows = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85
    assert n.get((0, 1), 0) / n[0, 0] < 0.01


def test_grammar_discounts_negation_and_reported_speech():
    rows = [("you are an idiot", 1)] * 30 + [("you are a friend", 0)] * 30
    m = toxicity.fit(rows)
    plain = m.clause("you are an idiot")
    assert 0 < m.clause("you are not an idiot") < plain
    assert 0 < m.clause("she said an idiot came by") < plain
    assert m.clause("the idiot") < plain
    assert m.clause("a quiet day") == 0


def test_composition_multiplies_factors():
    a = toxicity.window_rule(toxicity.NEGATION, (toxicity.INSULT,), 0.5, 2, True)
    b = toxicity.window_rule(toxicity.REPORT, (toxicity.INSULT,), 0.1, 2, False)
    c = toxicity.compose(a, b)
    state, out = 0, []
    for s in (toxicity.REPORT, toxicity.NEGATION, toxicity.INSULT, toxicity.INSULT):
        state, w, _ = c.step(state, s)
        out.append(w)
    assert out == [1.0, 1.0, 0.05, 1.0]


def test_matched_clauses_equal_plain_rules(spark, docs):
    """Every clause of a text by the rules one by one, without transducers and without triggers."""
    import re

    rng = np.random.default_rng(4)
    vocabulary = ["you", "they", "not", "never", "said", "reported", "kill", "hurt", "idiot", "idiots", "fool", "nice", "day", "the", ".", ";", "?", "\n"]
    m = toxicity.fit([("you are an idiot", 1)] * 30 + [("what a fool he is", 1)] * 30 + [("you are a friend of the day", 0)] * 60)
    assert {"idi", "foo"} <= {x[:3] for x in m.stems}
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary, rng.integers(1, 40)))
        total = most = 0.0
        for clause in re.split(r"[.!?;:\n]+", text.lower()):
            words, weight = re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause), 0.0
            kinds = [m.weigh(w) for w in words]
            negated = None
            for i, (k, w) in enumerate(kinds):
                factor = 1.0
                hit = k in (toxicity.INSULT, toxicity.THREAT)
                if k == toxicity.NEGATION:
                    negated = i
                if hit:
                    if negated is not None and i - negated <= 3:
                        factor *= 0.25
                        negated = None
                    if any(x == toxicity.REPORT for x, _ in kinds[max(0, i - 8):i]):
                        factor *= 0.6
                    if any(x == toxicity.TARGET for x, _ in kinds[max(0, i - 4):i]):
                        factor *= 1.25
                    if k == toxicity.THREAT:
                        factor *= 0.3
                weight += w * factor
            total, most = total + weight, max(most, weight)
        (got_total, got_most, _), _ = m.features(text)
        assert abs(got_total - total) < 1e-9 and abs(got_most - most) < 1e-9


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels, held_out_mod=10**9)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.tox_score <= 1 for r in rows)
    none = toxicity.fit_toxicity(odd, labels.limit(0))
    assert toxicity.score_toxicity(odd.limit(0), none).count() == 0


# -- decontamination

def plain_tiles(p, t, least):
    """Greedy string tiling by comparing every pair of positions."""
    free_p, free_t, tiles = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and free_p[i + k] and free_t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return tiles
        for x in range(k):
            free_p[i + x] = free_t[j + x] = False
        tiles.append((i, j, k))


def plain_cover(p, t, least):
    """Tokens that plain tiling covers, from a table of all diagonal runs."""
    free_p, free_t, have = np.ones(len(p), dtype=bool), np.ones(len(t), dtype=bool), 0
    while True:
        run, best = np.zeros(len(t) + 1, dtype=np.int64), (0, 0, 0)
        for i in range(len(p) - 1, -1, -1):
            run = np.append(np.where((t == p[i]) & free_t & free_p[i], run[1:] + 1, 0), 0)
            j = int(run.argmax())
            if run[j] >= best[0]:
                best = (int(run[j]), i, j)
        k, i, j = best
        if k < least:
            return have
        free_p[i:i + k] = free_t[j:j + k] = False
        have += k


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        p = rng.integers(0, rng.integers(1, 6), rng.integers(1, 25)).astype(np.uint64)
        t = np.concatenate([rng.integers(0, 6, 5).astype(np.uint64), p[len(p) // 2:], rng.integers(0, 6, 4).astype(np.uint64), p[:len(p) // 2]])
        least = int(rng.integers(1, 5))
        assert decontaminate.tile(p, t, least) == plain_tiles(p.tolist(), t.tolist(), least)


def test_tiling_of_repetitive_texts_ends():
    rng = np.random.default_rng(3)
    p, t = np.tile(np.arange(3, dtype=np.uint64), 700), np.tile(np.arange(3, dtype=np.uint64), 33_000)
    assert sum(k for _, _, k in decontaminate.tile(p, t, 5)) == len(p)
    p, t = rng.integers(0, 2, 800).astype(np.uint64), rng.integers(0, 2, 100_000).astype(np.uint64)
    assert sum(k for _, _, k in decontaminate.tile(p, t, 5)) > 0.9 * len(p)


def test_decontamination_equals_brute_force(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id, r.covered) for r in decontaminate.op10_decontamination(spark, DATA).collect()}
    items = {r.item_id: decontaminate.token_hashes(r.text) for r in bench.collect()}
    least = {i: min(5, len(p)) for i, p in items.items()}
    runs = {i: {p[k:k + least[i]].tobytes() for k in range(len(p) - least[i] + 1)} for i, p in items.items()}
    want = set()
    for r in docs.collect():
        t = decontaminate.token_hashes(r.text)
        seen = {w: {t[k:k + w].tobytes() for k in range(len(t) - w + 1)} for w in set(least.values())}
        for i, p in items.items():
            if len(p) and runs[i] & seen[least[i]]:
                have = plain_cover(p, t, least[i])
                if have >= 0.5 * len(p):
                    want.add((r.doc_id, i, have))
    assert want and got == want


def test_decontamination_with_hot_seeds_and_equal_names(spark):
    """One run stands in all documents and items; only what covers an item is found."""
    hot = "which of the following is"
    rows = [(i, f"{hot} own{i} words{i} here{i} and{i} there{i} so{i} on{i} for{i} ever{i} more{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("seed", F.lit(1))
    got = {(r.id, r.item_id, r.covered) for r in decontaminate.contaminated(df, df, id_col="id", item_col="id").collect()}
    assert got == {(i, i, 15) for i in range(60)}


def test_decontamination_finds_contained_items(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op10_decontamination(spark, DATA).collect()}
    items = {r.item_id: " ".join(decontaminate.TOKEN.findall(r.text.lower())) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        words = " " + " ".join(decontaminate.TOKEN.findall(r.text.lower())) + " "
        want |= {(r.doc_id, i) for i, t in items.items() if f" {t} " in words}
    assert want and want <= got


def test_reordered_passages_and_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (4, "two words"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "eta theta iota kappa lambda mu and then Alpha, beta gamma delta epsilon zeta."), (2, "alpha beta gamma is short"), (3, "here are two words")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.covered, r.tiles) for r in decontaminate.contaminated(rows, bench).collect()} == {(1, 1, 12, 2), (3, 4, 2, 1)}
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(rows.limit(0), bench).count() == 0
    assert decontaminate.contaminated(rows, bench.limit(0)).count() == 0


# -- pieces

def plain_viterbi(p, text, known={}):
    """Best summed score over all pieces of each run of text between spaces and line ends, position by position."""
    import re

    out = []
    for s in re.findall("\n+|▁*[^▁\n]+|▁+", "▁" + text.replace(" ", "▁")) if text else []:
        if s not in known:
            best = [(0.0, 0)]
            for e in range(1, len(s) + 1):
                found = []
                for k in range(1, min(p.longest, e) + 1):
                    i = p.ids.get(s[e - k:e])
                    if i is not None or k == 1:
                        found.append((best[e - k][0] + (p.score[s[e - k:e]] if i is not None else p.without), k, -1 if i is None else i))
                best.append(max(found))
            path, e = [], len(s)
            while e:
                _, k, i = best[e]
                path.append([i] if i >= 0 else [p.bytes[x] for x in s[e - 1].encode()])
                e -= k
            known[s] = [x for ids in reversed(path) for x in ids]
        out += known[s]
    return out


def test_pieces_equal_plain_viterbi(spark, docs):
    import sentencepiece

    p = pieces.loaded(pieces.default_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=p.path)
    rows = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pieces.encode(docs.repartition(3), block_chars=200_000).collect()}
    for r in docs.collect():
        assert rows[r.doc_id] == plain_viterbi(p, r.text)
        assert sp.decode(rows[r.doc_id]) == r.text


def test_pieces_equal_the_library_in_its_viterbi_mode(spark, docs):
    """The library's own lattice and Viterbi, by the same piece table marked as a unigram model; it sums in single precision, which the
    score of the lone space piece would swamp."""
    import re

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    p = pieces.loaded(pieces.default_model())
    model = sentencepiece_model_pb2.ModelProto()
    with open(p.path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = sorted({w for r in docs.limit(200).collect() for w in re.findall(r"\S+", r.text)})
    rows = pieces.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    alone = p.ids["▁"]
    seen = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        if alone not in ids:
            assert ids == library.nbest_encode(words[r.doc_id], nbest_size=2)[0]
            seen += 1
    assert seen > 0.9 * len(words) > 1000


def test_pieces_odd_texts(spark, odd):
    p = pieces.loaded(pieces.default_model())
    texts = ["Hello  world", " lead", "trail ", "tab\there", "中文 字符 😀", "a\n\nb", "x" * 5000, "   ", "▁odd▁", "éá", "a" * 199 + " b", "\n" + "y" * 300, "\0a \0 b", "ab" * 3000, " " * 700, "꧁" * 600, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "key", "word", "names", "n_pieces", "numbers")})
    rows = {r.doc_id: r for r in pieces.decode(pieces.encode(df, check=True).withColumn("text_", F.lit("?"))).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == plain_viterbi(p, t), t
        assert rows[i].text_ == (t or "").replace("▁", " ")
        assert rows[i].round_trip == (rows[i].text_ == (t or ""))
    out = pieces.encode(odd).collect()
    assert len(out) == odd.count()
    assert {r.doc_id: r.n_pieces for r in out}[1] == 0
    assert pieces.encode(odd.limit(0)).count() == 0
    assert pieces.decode(pieces.encode(odd.limit(0))).count() == 0
    nulls = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert sorted((r.text_ for r in pieces.decode(nulls).collect()), key=repr) == ["", None]


def test_pieces_of_repeated_ids_over_many_blocks(spark):
    rows = [(i % 3 if i % 4 else None, f"word{i} again and again {'z' * i}") for i in range(200)]
    p = pieces.loaded(pieces.default_model())
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), block_chars=100).collect()
    want = sorted((repr(i), plain_viterbi(p, t)) for i, t in rows)
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want


# -- neighbours

def test_neighbours_recall_and_scores(spark):
    path = "/root/testdata/sf0.1"
    rows = neighbours.op6_neighbours(spark, path).collect()
    e = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in e]), np.array([r[1] for r in e], dtype=np.float64)
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(d[ids == m[1]][0] - m[2]) < 1e-9 for m in mine)
        hit += len(set(best.tolist()) & {m[1] for m in mine})
    assert hit / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id % 100 = 0"), k=3).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0)]
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [2.0, 0.0]), (200, [3.0]), (7, [5.0]), (300, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    found = neighbours.nearest(twice, twice.where("vec_id % 100 = 0"), k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(0, 1, 1, 1.0), (200, 1, 7, 2.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


# -- quality, language, secrets

def test_quality_held_out(spark):
    path = "/root/testdata/sf0.1"
    rows = quality.op2_quality(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.quality, r.predicted): r["count"] for r in rows.groupBy("quality", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.95
    assert n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.8


def test_quality_scores_equal_plain_votes(spark, docs):
    """Cosines, nearest by (cosine, order), and votes, one by one."""
    import math

    texts = [r.text for r in docs.orderBy("doc_id").limit(300).collect()]
    rows = [(t, int(len(t) % 3 > 0)) for t in texts[:120]]
    m = quality.fit([*rows, *rows[:20]])  # repeated rows are equally near
    got = m.scores(texts[120:160])
    for t, score in zip(texts[120:160], got, strict=True):
        v = m.embed(quality.term_counts(t)[None])[0]
        cos = [(float(np.float32(c)), i) for i, c in enumerate((v[None] @ m.vectors.T)[0])]
        near = sorted(cos, key=lambda x: (-x[0], x[1]))[:15]
        votes = [(max(c, 0.0) ** m.power * m.weight[i], m.labels[i]) for c, i in near]
        assert math.isclose(score, sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs_tol=1e-4)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(odd, labels, held_out_mod=10**9)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.score_quality(odd.limit(0), quality.fit_quality(odd, labels.limit(0))).count() == 0


def test_language_held_out(spark, docs):
    rows = language.op8_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.where("lang = lang_pred").count() / rows.count() > 0.98


def test_language_margins_equal_plain_kernels(spark, docs):
    """Presence kernels of sets of hashed n-grams, one pair at a time."""
    rows = [(r.text[:400], r.lang) for r in docs.where("lang is not null and length(text) > 0").orderBy("doc_id").limit(80).collect()]
    m = language.fit(rows, landmarks=5)

    def grams(text):
        c, out = [ord(x) for x in f" {text.lower()} "], set()
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                h = 0
                for x in c[i:i + n]:
                    h = (h * 0x01000193 + x) % 2**32
                out.add((h * int(language.SALTS[n]) % 2**32) >> 14)
        return out

    marks = [grams(t) for name in m.names for t in [t for t, y in rows if y == name][:5]]
    texts = [r.text for r in docs.orderBy(F.desc("doc_id")).limit(25).collect()]
    got = m.margins(texts)
    for t, row in zip(texts, got, strict=True):
        x = grams(t)
        kernel = np.array([len(x & z) / (len(x) ** 0.5 * len(z) ** 0.5) for z in marks])
        assert np.allclose(kernel @ m.weights, row, atol=2e-3)


def test_language_odd_rows(spark, odd):
    model = language.fit_language(odd, modulus=10**9, held_out=-1)
    rows = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[6].lang_pred == "und"
    assert rows[3].lang_pred == "x"
    assert language.identify(odd.limit(0), language.fit_language(odd.limit(0))).count() == 0


def test_secrets_held_out(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = secrets.op3_secrets(spark, path).where("held_out").join(docs.select("doc_id", "text"), "doc_id")
    found = found.withColumn("s", F.expr("substring(text, start + 1, length)")).withColumn("b", F.expr("substring(text, greatest(start - 15, 0) + 1, least(start, 15))"))
    real = found.where("lower(b) rlike '(password|token)'")
    assert real.count() > 10 and real.where("is_secret").count() / real.count() > 0.95
    plain = found.where("s like '%@%'")
    assert plain.where("is_secret").count() / plain.count() < 0.02


def test_secrets_of_other_forms(spark):
    """Assigned passwords without a digit or of few characters are candidates; placeholders, digests and addresses are turned down."""
    rows = [(1, "the password = kXwQpLmVtR! and more"), (2, 'api_key: "Zq8#vT1$"'), (3, "commit 3f786850e387550fdab836ed7e6dc881de23001b of the file"), (4, "password = changeme for now"), (5, "write to anna.bell22@mail.com soon"),
            (6, "token = 9f86d081884c7d659a2feaa0c55ad015"), (7, "no secrets in this line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r.is_secret for r in secrets.scan(df).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    folder = [r for r in secrets.scan(df).columns]
    assert "secret_" not in folder and "before" not in folder


def test_secrets_learn_from_reviewed_findings(spark):
    rows = [(i, f"ticket number {10**11 + 7919 * i}x is open") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    reviewed = df.select("doc_id", F.lit(14).cast("long").alias("start"), F.lit(1).alias("label"))
    assert secrets.scan(df, reviewed).where("held_out and is_secret").count() > 0
    assert secrets.scan(df).where("held_out and is_secret").count() == 0


def test_secrets_odd_rows(spark, odd):
    assert secrets.scan(odd).count() == 0
    assert secrets.scan(odd.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 'password = "abcdef0123456789"'), (1, 'password = "abcdef0123456789"')], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert [r.start for r in secrets.scan(one, held_out_mod=10**9).collect()] == [12, 12]
