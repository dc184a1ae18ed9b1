"""op2, op7, op10 and the pipeline against brute force, planted cases and the library."""

import random
import re
import time
from array import array

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from coppice.llm import chains, graph, jaccard, pieces
from coppice.llm.common import table

SCHEMA = "doc_id BIGINT, text STRING"


def shingle_set(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_components(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    at = {d: d for d in texts}

    def root(d):
        while at[d] != d:
            d = at[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def chain_of_copies():
    """Neighbours are linked, ends are not; copies, blanks, nulls and short texts besides."""
    words = [f"w{k}" for k in range(100)]
    out = {}
    for k in range(6):
        out[1000 + k] = " ".join(words)
        words[7 * k + 3] = f"x{k}"
    return out | {1100: "One two", 1101: "one TWO", 1102: "", 1103: None, 1104: " \t\n", 1105: "é É", 1106: "é é", 1107: "a a a a a a"}


def test_jaccard_join_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()} | chain_of_copies()
    got = jaccard.join(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_jaccard_join_of_no_rows(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_ids_link_nothing_and_repeated_rows_are_returned(spark):
    rows = [(None, "a b c d e f", 1, "p"), (5, "a b c d e f", 2, "q"), (7, "A B c d e f", 3, "r"), (7, "A B c d e f", 3, "r"), (None, None, 0, "")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string, component_id bigint, rep string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, None), (5, 2, 5), (7, 2, 5), (7, 2, 5), (None, 0, None)], key=repr)


def test_one_document_of_each_group_stays(spark):
    texts = chain_of_copies()
    kept = jaccard.keep_one(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in brute_components(texts).values()})


def test_null_and_repeated_ids_stay(spark):
    rows = [(None, "one two three", 3), (None, "one two three", 3), (None, "other words here", 1), (None, None, 2), (7, "first text of seven", 2), (7, "first text of seven", 1), (7, "a second text", 5), (8, "one two three", 0), (9, "one two three", 0), (6, None, 1), (6, None, 1), (8, "a second text", 0), (8, "a third text", 0)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, n int"))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([*rows[:4], rows[5], rows[6], rows[7], rows[9], rows[12]], key=repr)


@pytest.mark.parametrize("chunk,fan", [(pieces.CHUNK_CHARS, 32), (64, 3), (500, 32)])
def test_encoding_equals_the_library(spark, sf_dir, monkeypatch, chunk, fan):
    monkeypatch.setattr(pieces, "FAN", fan)
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").limit(60).collect()}
    texts |= {5000: "", 5001: None, 5002: "  two  spaces ", 5003: "\U0001f600 \x00 漢字", 5004: "a" * 5000, 5005: "ab " * 3000}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(spark.createDataFrame(list(texts.items()), SCHEMA), pieces.read_model(spark), chunk).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r.ids) == library.encode(texts[r.doc_id] or ""), r.doc_id
        assert r.n_tokens == len(r.ids) and r.round_trip


def test_products_of_matrices_are_associative():
    v = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
    text = v.prepared("internationalisation of aaaaaaaaaa and 漢字漢字 \U0001f600\U0001f600 uncharacteristically " * 4)
    cuts = [*range(0, len(text), 40), len(text)]
    parts = [v.matrix(text[max(a - v.longest, 0) : b + v.longest], min(a, v.longest), min(a, v.longest) + b - a) for a, b in zip(cuts, cuts[1:])]
    left, right = parts[0], parts[-1]
    for m in parts[1:]:
        left = pieces.combined(left, m)
    for m in parts[-2::-1]:
        right = pieces.combined(m, right)
    assert left == right and len({e[:2] for e in left}) == 1


def test_encoding_of_repeated_odd_and_no_rows(spark):
    model = pieces.read_model(spark)
    rows = [(None, "long words " * 40, 1, "x"), (None, "long words " * 40, 2, "y"), (3, "long words " * 40, 3, "z"), (3, "other words " * 40, 3, "z"), (None, None, 0, ""), (5, "", 0, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, round_trip string")
    got = pieces.encode(frame, model, 64)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and all(r.round_trip for r in got.collect())
    back = pieces.decode(got, model)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((d, t or "") for d, t, _, _ in rows), key=repr)
    assert pieces.encode(frame.where("false"), model, 64).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [])], "at int, ids array<int>")
    assert [r.text for r in pieces.decode(odd, model).collect()] == ["", ""]


def test_planted_passages_are_found(spark):
    shared = [f"p{k}" for k in range(120)]
    near = [w if k % 30 != 17 else "changed" for k, w in enumerate(shared)]
    texts = {
        1: " ".join([*(f"a{k}" for k in range(80)), *shared]), 2: " ".join([*near, *(f"b{k}" for k in range(50))]),
        3: " ".join(f"c{k}" for k in range(300)), 4: None, 5: "", 6: "short",
    }
    got = chains.passages(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    assert {(r.doc_id, r.src_doc_id) for r in got} == {(2, 1)}
    assert sum(r.end_word - r.start_word for r in got) >= 100
    assert chains.passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_passages_survive_what_lies_around_them(spark):
    exact, seed = [f"p{k}" for k in range(50)], [f"s{k}" for k in range(8)]
    other, middle = [f"q{k}" for k in range(40)], [f"r{k}" for k in range(60)]
    texts = {
        1: " ".join([*exact, *(f"a{k}" for k in range(20)), *seed, *(f"b{k}" for k in range(30))]),
        2: " ".join([*exact, *(f"c{k}" for k in range(20)), *seed, *(f"d{k}" for k in range(30))]),
        10: " ".join([*other[:20], *(f"e{k}" for k in range(20)), *other[20:]]), 11: " ".join(middle),
        12: " ".join([*other[:20], *(f"f{k}" for k in range(20)), *other[20:], *middle]),
    }
    got = chains.passages(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    assert any(r.doc_id == 2 and r.src_doc_id == 1 and r.start_word <= 0 and r.end_word >= 50 for r in got), got
    assert any(r.doc_id == 12 and r.src_doc_id == 11 and r.start_word <= 60 and r.end_word >= 120 for r in got), got
    assert all(r.identity >= 0.8 and r.n_equal == round(r.identity * (r.end_word - r.start_word)) for r in got)


def test_every_copy_in_a_document_is_found(spark):
    shared = [f"p{k}" for k in range(60)]
    parts = [w for c in "abc" for w in [*shared, *(f"{c}{k}" for k in range(40))]]
    texts = {1: " ".join(["x y z", *shared]), 2: " ".join(parts), 3: " ".join(["w", *shared, "v"]), 4: "same " * 3000, 5: "same " * 4000}
    got = chains.passages(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    assert sorted((r.start_word, r.end_word) for r in got if r.doc_id == 2) == [(0, 60), (100, 160), (200, 260)]
    assert [(r.start_word, r.end_word) for r in got if r.doc_id == 3] == [(1, 61)]
    assert [(r.start_word, r.end_word, r.src_doc_id) for r in got if r.doc_id == 5] == [(0, 4000, 4)]


def test_stated_identity_is_found(spark):
    rows = []
    for d in range(0, 200, 2):
        base = [f"w{d}x{k}" for k in range(50)]
        for k, w in enumerate([[f"l{d}x{k}" for k in range(20)] + base, [w if k != 25 else f"new{d}x{k}" for k, w in enumerate(base)] + [f"r{d}x{k}" for k in range(20)]]):
            rows.append((d + k, " ".join(w)))
    got = {(r.doc_id, r.src_doc_id) for r in chains.passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(d + 1, d) for d in range(0, 200, 2)}


def test_extension_goes_over_indels():
    base = list(range(60))
    copy = [*base[:20], 901, *base[20:33], *base[34:47], 902, 903, *base[47:]]
    for d, s, seed in ((copy, base, (0, 0, 8)), (copy, base, (len(copy) - 8, 52, 8)), (base, copy, (0, 0, 8))):
        assert sum(n for _, _, n in chains.align(d, s, [seed])) == 59


def test_chains_aligned_together_are_aligned_as_alone():
    rng = random.Random(6)
    texts = [[rng.randrange(6) if rng.random() < 0.2 else k for k in range(rng.choice((1, 9, 60, 3000)))] for _ in range(30)]
    sides = [[array("q", t) for t in texts], [array("q", t + t[3:40]) for t in texts]]
    jobs = [(k, p, [(0, 0, 1)]) for k in range(30) for p in range(30)] + [(k, k, [(len(texts[k]) // 2, len(texts[k]) // 2, 1)]) for k in range(30)]
    together = chains.align_all(*sides, jobs)
    assert together == [chains.align(texts[k], list(sides[1][p]), segments) for k, p, segments in jobs]
    assert all(texts[k][x : x + n] == list(sides[1][p][y : y + n]) for (k, p, _), runs in zip(jobs, together) for x, y, n in runs)


def test_matches_over_batch_borders():
    rows = sorted((int(s), int(q), int(d), int(a)) for s, q, d, a in np.random.default_rng(5).integers(0, (3, 2, 6, 6), (150, 4)))
    wanted = []
    for key in sorted({r[:2] for r in rows}):
        here = [(d, a) for *k, d, a in rows if tuple(k) == key]
        places = {d: min(a for e, a in here if e == d) for d in sorted({e for e, _ in here})}
        docs = list(places)
        for d, a in here:
            wanted += [(d, p, a, places[p]) for p in {docs[0], docs[max(docs.index(d) - 1, 0)]} if p != d]
    for size in (1, 2, 7, 150):
        cut = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size])], ["seed", "part", "doc", "at"]) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in chains._matches(iter(cut)) for r in b.to_pylist()]
        assert sorted(got) == sorted(wanted)


def test_passages_of_common_seeds_are_matched_to_their_source(spark):
    """Every seed of the passage stands alone in many other documents too, so that neither its first nor its previous document holds the passage."""
    rng, size = random.Random(4), 70  # window 1: each k-mer is a seed, also in the other documents
    for others in (3, 2 * chains.MANY):
        passage = [f"p{k}" for k in range(size)]
        pieces_of = [[w for k in range(a, size - 3, 4) for w in [*passage[k : k + 4], *(f"z{rng.randrange(10**9)}" for _ in range(100))]] for a in range(4)]
        rows = [(10 + 4 * n + a, " ".join(pieces_of[a])) for n in range(others) for a in range(4)]
        rows += [(1000, " ".join([*(f"s{k}" for k in range(30)), *passage]))]
        rows += [(2000 + 4 * n + a, " ".join(pieces_of[a])) for n in range(others) for a in range(4)]
        rows += [(9000, " ".join([*passage, *(f"t{k}" for k in range(30))]))]
        got = [(r.src_doc_id, r.start_word, r.end_word) for r in chains.passages(spark.createDataFrame(rows, SCHEMA), chains.Chaining(window=1)).collect() if r.doc_id == 9000]
        assert got == [(1000, 0, size)]


def test_hot_seeds_are_dealt_over_ranges_of_documents(spark, monkeypatch):
    """A line in every document, and other passages: with hot seeds the same passages as without, but for their sources."""
    rng, line = random.Random(3), " ".join(f"l{k}" for k in range(60))
    texts = [(d, " ".join([*(f"w{rng.randrange(10**9)}" for _ in range(40)), line, *(f"w{rng.randrange(10**9)}" for _ in range(40))])) for d in range(90)]
    frame = spark.createDataFrame(texts, SCHEMA)
    found = {}
    for hot in (1, 2048):
        monkeypatch.setattr(chains, "HOT", hot)
        assert chains.hot_cells(frame, chains.Chaining()).any() == (hot == 2048)
        found[hot] = sorted((r.doc_id, r.start_word, r.end_word) for r in chains.passages(frame).collect())
    assert found[1] == found[2048] == [(d, 40, 100) for d in range(1, 90)]


def test_ranges_of_documents_are_the_same_however_rows_are_dealt(spark):
    frame = spark.range(20_000).selectExpr("id * id as doc_id")
    cuts = {chains._cuts(f) for f in (frame, frame.repartition(7), frame.orderBy(frame.doc_id.desc()))}
    assert len(cuts) == 1 and len(bounds := cuts.pop()) == chains.PARTS - 1
    held = np.histogram(np.arange(20_000) ** 2, [-1, *bounds, 20_000**2])[0]
    assert held.min() > 100 and held.max() < 700


def test_accepted_pieces_equal_brute_force():
    how, rng = chains.Chaining(min_words=6), np.random.default_rng(3)
    for _ in range(300):
        equal = rng.random(40) < rng.choice([0.5, 0.7, 0.9])
        wanted = np.zeros(40, bool)
        for a in range(40):
            for b in range(a + 6, 41):
                if equal[a] and equal[b - 1] and 10 * equal[a:b].sum() >= 8 * (b - a):
                    wanted[a:b] = True
        found = np.zeros(40, bool)
        for a, b in chains.accepted(equal, how):
            found[a:b] = True
        assert (found == wanted).all()


def test_pipeline_stages(spark, sf_dir):
    names = table(spark, sf_dir, "documents").columns
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) and all(r.round_trip for r in out)
    assert len({r.doc_id for r in out}) == len(out)


def test_recall_of_fuzzy_passages(spark):
    """Planted copies of 150 words with up to 18 edits in 100: at least 0.9 of them, and of their words, are found."""
    rng, rows, places = random.Random(9), [], {}
    word = lambda: f"w{rng.randrange(10**9)}"
    for k in range(160):
        base = [word() for _ in range(150)]
        copy = []
        for w in base:
            kind = rng.choice("sdi" if k % 2 else "s") if rng.random() < (0.05, 0.1, 0.15, 0.18)[k // 2 % 4] else ""
            copy += {"": [w], "s": [word()], "d": [], "i": [w, word()]}[kind]
        rows += [(2 * k, " ".join([*(word() for _ in range(30)), *base])), (2 * k + 1, " ".join([*copy, *(word() for _ in range(30))]))]
        places[2 * k + 1] = len(copy)
    got = chains.passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.src_doc_id == r.doc_id - 1 and r.identity >= 0.75 for r in got)  # a union of pieces can be less equal than each
    assert len({r.doc_id for r in got}) >= 0.9 * len(places)
    assert sum(min(r.end_word, places[r.doc_id]) - r.start_word for r in got) >= 0.9 * sum(places.values())


def test_passages_of_odd_rows(spark):
    text = " ".join(f"p{k}" for k in range(70))
    rows = [(None, text, 1, "a"), (1, text, 2, "b"), (1, text, 2, "b"), (2, text.upper(), 3, "c"), (3, None, 4, "d"), (4, " \n\t ", 5, "e"), (5, text + " " + "x " * 60_000, 6, "f")]
    got = chains.passages(spark.createDataFrame(rows, "doc_id bigint, text string, seed int, src string")).collect()
    assert sorted((r.doc_id, r.src_doc_id, r.start_word, r.end_word) for r in got) == [(2, 1, 0, 70), (5, 1, 0, 70)]


def test_passages_leave_no_files_of_seeds(spark):
    """Before texts are aligned the files of seeds and matches are gone (before: 1.2 MB left, and none freed)."""
    rng, n = random.Random(8), 40
    base = [f"b{k}" for k in range(400)]
    rows = [(d, " ".join(w if rng.random() > 0.02 else f"r{rng.randrange(10**9)}" for w in base)) for d in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = map(spark._jvm.java.io.File, filter(None, disk.getAllFiles().mkString("\n").split("\n")))
        return {f.getName(): f.length() for f in files if f.getName().endswith(".data")}

    before = set(shuffled())
    found = chains.passages(frame)
    for _ in range(40):  # they are deleted beside the query
        left = sum(size for name, size in shuffled().items() if name not in before)
        if left < 300_000:
            break
        time.sleep(0.25)
    assert left < 300_000
    assert {r.doc_id for r in found.collect()} == set(range(1, n))


def near_copies(seed, n):
    """Families of texts at all distances: copies of copies with some words replaced, and loose relatives."""
    rng = random.Random(seed)
    base = [[f"b{f}w{k}" for k in range(60)] for f in range(3)]
    out = {}
    for d in range(n):
        words = list(base[rng.randrange(3)])
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6, 10))):
            words[rng.randrange(60)] = f"r{rng.randrange(40)}"
        out[d] = " ".join(words[: rng.choice((60, 60, 55, 30))])
    return out


@pytest.mark.parametrize("spread", [1, 10**6])
def test_components_of_hubs_and_chains(spark, monkeypatch, spread):
    monkeypatch.setattr(graph, "SPREAD", spread)
    links = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 140)] + [(300, 200), (200, 250), (7, 7), (400, 400)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(60)} | {k: 100 for k in range(100, 141)} | {200: 200, 250: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("block,percent", [(4, 80), (16, 60), (10_000, 80)])
def test_large_groups_are_divided_exactly(spark, block, percent):
    texts = near_copies(block + percent, 120)
    sets = {d: shingle_set(t) for d, t in texts.items()}
    at = dict.fromkeys(texts)
    for d in at:
        at[d] = d

    def root(d):
        while at[d] != d:
            d = at[d]
        return d

    for a in texts:
        for b in range(a + 1, len(texts)):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    got = jaccard.join(spark.createDataFrame(list(texts.items()), SCHEMA), jaccard.Join(block=block, percent=percent, region=6)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: root(d) for d in texts}


@pytest.mark.parametrize("how", [jaccard.Join(region=2, sketched=3, table_bits=1), jaccard.Join(region=2, sketched=3, table_bits=1, percent=40), jaccard.Join(region=6, table_bits=1)])
def test_documents_of_a_common_passage_form_no_group(spark, monkeypatch, how):
    """Pivots that many unlike documents share link no more of them than sketches must let pass."""
    rng, common = random.Random(7), [f"c{k}" for k in range(24)]
    texts = {d: " ".join([*common, *(f"w{rng.randrange(10**6)}" for _ in range(50 + d % 40))]) for d in range(120)}
    texts |= {200 + d: " ".join([*texts[d].split()[:-3], "x", "y", "z"]) for d in range(0, 120, 10)}
    texts |= {300 + d: f"{texts[0]} {d}" for d in range(12)}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= how.percent * len(sets[a] | sets[b])]
    seen, whole = [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda frame, candidates, how: seen.extend(map(tuple, graph.components(candidates).collect())) or whole(frame, candidates, how))
    got = jaccard.join(spark.createDataFrame(list(texts.items()), SCHEMA), how).collect()
    want = dict(map(tuple, graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert {r.doc_id: r.component_id for r in got} == {d: want.get(d, d) for d in texts}
    assert how.percent < 80 or len(seen) < len(texts) / 2


def test_near_duplicates_of_the_pipeline_form_no_group_of_unlike_documents(spark, sf_dir, monkeypatch):
    """With counts that tell no shingles apart, as in very large corpora, a common passage makes no group."""
    rng, common = random.Random(8), [f"c{k}" for k in range(30)]
    rows = [(d, " ".join([*common, *(f"w{rng.randrange(10**9)}" for _ in range(60))])) for d in range(60)]
    rows += [(100 + d, rows[d][1] + " end") for d in range(0, 60, 6)]
    seen, whole = [], jaccard._linked
    monkeypatch.setattr(jaccard, "shingle_counts", lambda docs, how: np.zeros(1 << how.table_bits, np.int64))
    monkeypatch.setattr(jaccard, "_linked", lambda frame, candidates, how: seen.extend(graph.components(candidates).collect()) or whole(frame, candidates, how))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == list(range(60))
    assert len(seen) == 20


def test_sketches_exclude_no_link():
    rng = np.random.default_rng(5)
    for percent in (30, 80):
        how, base = jaccard.Join(percent=percent), rng.integers(0, 2**63, 3000).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[:k][rng.random(k) < 0.95], rng.integers(0, 2**63, rng.integers(0, 1 + k // 4)).astype(np.uint64)])) for k in rng.integers(1, 3000, 60)]
        sets = sorted((s for s in sets if len(s)), key=len)
        n, side = np.array([len(s) for s in sets]), rng.integers(0, 2, len(sets))
        sketches = jaccard._sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n).to_pylist()
        for sides in (np.zeros(len(sets), np.int64), side):
            pairs, at = jaccard.alike(n, sides, sketches, how), list(range(len(sets)))
            for _ in sets:
                for a, b in pairs:
                    at[a] = at[b] = min(at[a], at[b])
            for a in range(len(sets)):
                for b in range(a):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * both >= percent * (n[a] + n[b] - both) and (sides.max() == 0 or sides[a] != sides[b]):
                        assert at[a] == at[b]


def test_pipeline_of_odd_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    good = sorted(docs.where("length(text) > 600").limit(6).collect(), key=lambda r: r.doc_id)
    names, last = docs.columns, good[-1].asDict()
    odd = [r.asDict() for r in good] + [last, last | {"text": good[0].text}, good[1].asDict() | {"doc_id": None}, good[1].asDict() | {"doc_id": None}, last | {"doc_id": 10**7, "text": None}, last | {"doc_id": 10**7 + 1, "text": ""}, last | {"lang": None, "source": None, "n_chars": None, "doc_id": 10**7 + 2}]
    frame = spark.createDataFrame([tuple(r[c] for c in names) for r in odd], docs.schema)
    kept = [frame]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf_dir))
        assert kept[-1].columns == names
    first = [r.asDict() for r in kept[1].collect()]
    assert all(r["text"] for r in first) and sum(r["doc_id"] is None for r in first) in (0, 2)
    after = [r.asDict() for r in kept[3].collect()]
    pairs = [(r["doc_id"], r["text"]) for r in after if r["doc_id"] is not None]
    assert len(set(pairs)) == len(pairs) and sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in first)
    out = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf_dir).collect()
    assert len(out) == kept[-1].count() and all(r.round_trip for r in out)
    none = frame.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, none, sf_dir)
        assert none.columns == names and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf_dir).count() == 0


def shuffled(spark, make):
    """Bytes that the stages of make() write to shuffles."""
    jvm = spark._jvm
    context, none = spark.sparkContext, jvm.java.util.ArrayList()

    def total():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(none, False, False, context._gateway.new_array(jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    before, out = total(), make()
    return out, sum(n for k, n in total().items() if k not in before)


def test_near_duplicates_of_the_pipeline_shuffle_few_texts(spark, sf_dir):
    rng = random.Random(5)
    texts = {d: " ".join(f"{rng.getrandbits(60):015x}" for _ in range(300)) for d in range(400)}
    texts |= {1000 + d: texts[d] + " end" for d in range(5)} | {2000: texts[7]}
    docs = spark.createDataFrame([*texts.items(), (1000, "another text"), (8, texts[8])], SCHEMA)
    (kept, n) = shuffled(spark, lambda: corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([*((d, texts[d]) for d in range(400)), (1000, "another text")])
    assert n < sum(map(len, texts.values()))


def test_windows_of_a_checkpoint_go_once_regions_are_made(spark):
    rng = random.Random(6)
    rows = [(d, " ".join(f"{rng.getrandbits(60):015x}" for _ in range(500))) for d in range(500)]
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    jaccard.checkpointed(spark.range(1))
    folder = jvm.org.apache.hadoop.fs.Path(spark._jsc.sc().getCheckpointDir().get())

    def held():
        return folder.getFileSystem(hadoop).getContentSummary(folder).getLength()

    before = held()
    links = jaccard.classes(spark.createDataFrame(rows, SCHEMA))[2]
    assert links.isEmpty()
    windows = 500 * 100 * 8
    assert held() - before < windows


def test_units_of_a_slice_are_looked_up_once_each(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 4)
    with open(pieces.MODEL, "rb") as file:
        v = pieces.Vocabulary(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    calls, unit = [], v.unit
    monkeypatch.setattr(v, "unit", lambda text: calls.append(text) or unit(text))
    texts = ["one two, three four. five six; seven\n" * 50, "", "seven six five ☃\U0001f600 " * 40, "seven"]
    ids, offsets = v.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t) for t in texts]
    assert len(calls) == len(set(calls))
