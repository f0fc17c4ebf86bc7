"""Operators over the whole corpus, against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, prose
from harness import DATA
from pyspark.sql import functions as F

from sextant.llm import _neardup, bagminhash, langid, line_dedup, mixing, paragraphs


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.comp for r in _neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    names = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(names)}
    pairs = {(place[a], place[b]) for a, b in edges} | {(place[b], place[a]) for a, b in edges}
    want = groups(len(names), lambda i, j: (i, j) in pairs)
    single = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {x: names[want[i]] for i, x in enumerate(names) if x in got}
    assert set(names) - set(got) <= single


def test_blocks_lose_no_link(spark, monkeypatch):
    """A candidate component in which only neighbours are similar, over many blocks."""
    monkeypatch.setattr(_neardup, "BLOCK", 4)

    class Close(_neardup.Same):
        def same(self, a, b):
            return abs(int(a) - int(b)) <= 1

    order = list(range(60))
    random.Random(3).shuffle(order)
    members = spark.createDataFrame([(i, 0, str(v if v < 30 else v + 5)) for i, v in enumerate(order)], "node long, comp long, item string")
    got = _neardup.classes(members, Close).groupBy("comp").count().collect()
    assert sorted(r["count"] for r in got) == [30, 30]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    for _ in range(3):
        n, value = 200, rng.integers(0, 1 << 62, 200).astype(np.uint64)
        wa = rng.integers(0, 9, n)
        wb = np.where(rng.random(n) < 0.7, wa, rng.integers(0, 9, n))
        a, b = wa > 0, wb > 0
        s = bagminhash.signatures(np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)]), np.concatenate([value[a], value[b]]), np.concatenate([wa[a], wb[b]]), 2, 2048)
        j = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((s[0] == s[1]).mean() - j) < 4 * (j * (1 - j) / 2048) ** 0.5


def test_near_duplicates_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    how = bagminhash.Overlap()
    ready = [how.prepare(r.text) for r in rows]
    want = groups(len(rows), lambda i, j: how.same(ready[i], ready[j]))
    ids = [r.doc_id for r in rows]
    least = defaultdict(lambda: 1 << 60)
    for i, g in enumerate(want):
        least[g] = min(least[g], ids[i])
    got = bagminhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {ids[i]: least[g] for i, g in enumerate(want)}
    assert Counter(r.class_id for r in got if r.kept) == Counter(dict.fromkeys(set(least.values()), 1))


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    rows = bagminhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == {1} and by[5] == by[6] == by[7] == {5} and by[8] == by[9] == {8} and by[4] == {4}
    kept = bagminhash.pipeline_stage(spark, odd, DATA)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert bagminhash.near_duplicates(empty).count() == 0


def test_near_duplicates_with_one_id(spark):
    """Rows that share an id, or have none, meet by their texts: this many would not end if they met by the id."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(3)).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat(F.floor(F.col("id") / 4), F.lit(f"-{k}"))) for k in range(6)]).alias("text"))
    got = bagminhash.near_duplicates(rows)
    assert got.agg(F.count("*"), F.sum("class_size"), F.count(F.when(F.col("kept"), 1))).first() == (20_000, 80_000, 5_000)


def test_alike_pairs_are_those_of_the_edit_distance(spark):
    random.seed(14)
    made = ["".join(random.choice("ab é") for _ in range(random.randint(0, 60))) for _ in range(60)]
    items = made + ["".join(c if random.random() < 0.8 else random.choice("xyzé") for c in x) for x in made]
    pairs = [(i, i + 60) for i in range(60)]
    how = line_dedup.Edits()
    got = line_dedup.alike_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(enumerate(items)), "node long, item string"), 0.8)
    assert {tuple(r) for r in got.collect()} == {(a, b) for a, b in pairs if how.same(how.prepare(items[a]), how.prepare(items[b]))}


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    random.seed(6)
    how = line_dedup.Edits()
    for k in range(400):
        a = "".join(random.choice("abcd ") for _ in range(random.randint(0, 300 if k % 9 == 0 else 40)))
        b = "".join(c if random.random() < 0.85 else random.choice(["", "x", c + "y"]) for c in a) if k % 2 else "".join(random.choice("abcd ") for _ in range(random.randint(0, 40)))
        d = plain(a, b)
        assert line_dedup.distance(a, b) == d
        assert how.same(how.prepare(a), how.prepare(b)) == (d <= int(max(len(a), len(b)) * 0.2 + 1e-9))


def test_signature_join_finds_all(spark, monkeypatch):
    """SimHashes within 3 bits that meet in a bucket, also where a bucket goes on in pairs of blocks."""
    random.seed(7)
    base = [random.getrandbits(64) for _ in range(60)]
    sigs = sorted({b ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 3))) & (1 << 64) - 1 for b in base * 20})
    signed = [s - (1 << 64) if s >> 63 else s for s in sigs]
    want = groups(len(sigs), lambda i, j: (sigs[i] ^ sigs[j]).bit_count() <= 3)
    rows = spark.createDataFrame([(k, s, None) for s in signed for k in (0, s)] * 2, "bucket long, node long, item string")
    for run in (2048, 100):  # the second sends the one large bucket through pairs of blocks
        monkeypatch.setattr(line_dedup, "RUN", run)
        got = {r.node: r.comp for r in _neardup.components(line_dedup.bucket_links(rows, lambda: line_dedup.Near(3)).select("a", "b")).collect()}
        assert len({got.get(s, s) for s in signed}) == len(set(want))
        assert all((got.get(signed[i], signed[i]) == got.get(signed[want[i]], signed[want[i]])) for i in range(len(sigs)))


def test_short_lines_of_a_large_bucket(spark, monkeypatch):
    random.seed(8)
    items = sorted({"".join(random.choice("ab") for _ in range(random.randint(5, 9))) for _ in range(150)})
    how = line_dedup.Edits()
    want = groups(len(items), lambda i, j: how.same((items[i], None, None), (items[j], None, None)))
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(items)], "bucket long, node long, item string")
    for run in (2048, 20):
        monkeypatch.setattr(line_dedup, "RUN", run)
        got = {r.node: r.comp for r in _neardup.components(line_dedup.bucket_links(rows, lambda: line_dedup.Alike(0.8)).select("a", "b")).collect()}
        assert [got.get(i, i) for i in range(len(items))] == want


def test_simhash_by_bytes_is_a_majority_of_bits():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 3, 254, 255, 256, 700, 2])
    hashes = rng.integers(0, 1 << 63, int(sizes.sum())).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    got = line_dedup.simhash(hashes, starts)
    for k, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        bits = np.unpackbits(hashes[a : a + n].view(np.uint8).reshape(-1, 8), axis=1).sum(0)
        assert (np.packbits(2 * bits > n).view(np.int64) == got[k]).all()


def test_line_dedup_against_ungated_similarity(spark, docs):
    """What op1_line_dedup and the pipeline call, against edit similarity alone."""
    random.seed(9)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8))) for _ in range(300)]
    made = []
    for n in (2, 3, 4, 6, 10, 20, 50):
        for _ in range(12):
            line = random.choices(words, k=n)
            other = list(line)
            for _ in range(max(1, n // 10)):  # a word replaced in ten, or one added
                if n > 4:
                    other[random.randrange(n)] = random.choice(words)
            made += [" ".join(line), " ".join(other) if n > 4 else " ".join(line) + random.choice("xyz")]
    rows = [(-1 - k, line) for k, line in enumerate(made)] + [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    first, norm = {}, {}
    for d, text in sorted(rows):
        for p, line in enumerate(text.split("\n")):
            if flat := line_dedup.normal(line):
                first.setdefault(flat, (d, p))
    keys, how = sorted(first, key=first.get), line_dedup.Edits()
    ready = [how.prepare(k.decode()) for k in keys]
    root = groups(len(keys), lambda i, j: how.same(ready[i], ready[j]))
    gone = {first[keys[i]] for i, g in enumerate(root) if i != g}
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, p) for r in line_dedup.removals(whole).collect() for p in r.removed}
    firsts = set(first.values())
    assert len(gone - got) <= 0.02 * len(gone) and not (got & firsts) - gone and len(gone) > 60
    few = {first[keys[i]] for i, g in enumerate(root) if i != g and len(keys[i]) < line_dedup.SHORT and len(keys[g]) < line_dedup.SHORT}
    assert few and few <= got
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(whole).collect()}
    for d, text in rows:
        parts = text.split("\n")
        assert lines[d].text == "\n".join(x for p, x in enumerate(parts) if (d, p) not in got)
        assert lines[d].n_lines == sum(bool(line_dedup.normal(x)) for x in parts)


def test_pieces_find_every_short_pair():
    random.seed(10)
    how, alike = line_dedup.Edits(), 0
    for _ in range(20000):
        a = "".join(random.choice("abc") for _ in range(random.randint(1, 24)))
        b = "".join(c if random.random() < 0.85 else random.choice(["", "a", c + "b"]) for c in a)[:24]
        if b and how.same(how.prepare(a), how.prepare(b)):
            alike += 1
            assert line_dedup.pieces(a) & line_dedup.pieces(b), (a, b)
    assert alike > 3000


def test_line_dedup_of_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines_", "n_removed"]  # the first name was taken
    rows = out.collect()
    assert len(rows) == odd.count()
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    assert texts[2] == [""] and texts[5] == [None] and texts[7] == [" \n\t "] and len(set(texts[10])) == 1 and texts[9] == [""]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_passages_in_odd_rows(odd, empty):
    rows = paragraphs.repeats(odd).collect()
    ids = {r.doc_id for r in rows}
    assert {1, 2, 15, 16} <= ids and not ids & {4, 5, 6, 7, 8, 9, 10, 11, 12}
    assert any(r.removed for r in rows if r.doc_id == 16) and not any(r.removed for r in rows if r.doc_id == 15)
    assert paragraphs.repeats(empty).count() == 0
    assert paragraphs.bands() == 5


def test_passages_of_fifty_words(docs):
    width, seen = 50, defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        words = r.text.lower().encode().split()
        for i in range(len(words) - width + 1):
            seen[tuple(words[i : i + width])].add(r.doc_id)
    repeated = {d for s in seen.values() if len(s) > 1 for d in s}
    got = {r.doc_id for r in paragraphs.repeats(docs).collect()}
    assert len(repeated - got) <= 0.05 * len(repeated) and repeated


def test_passages_that_cuts_miss(spark, docs):
    """Every stretch of 50 words in two documents is overlapped wherever it starts and ends, and planted ones are reported whole."""
    random.seed(12)
    words = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    made = []
    for k in range(40):
        passage = random.choices(words, k=50)
        for d in range(2):
            before, after = random.choices(words, k=random.randint(5, 60)), random.choices(words, k=random.randint(5, 60))
            made.append((10_000 + 2 * k + d, " ".join(before + passage + after), len(before)))
    planted = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    got = defaultdict(list)
    for r in paragraphs.repeats(planted).collect():
        got[r.doc_id].append((r.first_word, r.n_words, r.n_removed))
    # a word more where hosts agree by chance; single words are paragraphs, too
    assert all(len(got[d]) == 1 and got[d][0][0] in (first - 1, first) and 50 <= got[d][0][1] <= 52 for d, _, first in made)
    assert all(got[d][0][2] >= 50 if d % 2 else got[d][0][2] <= 2 for d, _, _ in made)
    spots = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        flat = r.text.lower().encode().split()
        for i in range(len(flat) - 49):
            spots[tuple(flat[i : i + 50])].append((r.doc_id, i))
    found = defaultdict(list)
    for r in paragraphs.repeats(docs).collect():
        found[r.doc_id].append((r.first_word, r.first_word + r.n_words))
    repeated = [x for s in spots.values() if len({d for d, _ in s}) > 1 for x in s]
    assert repeated and all(any(a < i + 50 and i < b for a, b in found[d]) for d, i in repeated)


def test_mix_nears_its_targets(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    gap = lambda rate: sum((sum(r.n_tokens * r[f"p_{n}"] * rate(r) for r in rows) / total - share) ** 2 for n, share in mixing.TARGETS.items())
    assert gap(lambda r: r.rate) < 0.25 * gap(lambda r: 1.0)  # this classifier is too unsure for the targets themselves
    assert all(abs(sum(r[f"p_{n}"] for n in mixing.TARGETS) - 1) < 1e-9 for r in rows)
    none = spark.createDataFrame([(None, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    even = mixing.mix(odd, none).collect()
    assert len(even) == odd.count() and all(abs(r.p_clean - 1 / 3) < 1e-9 for r in even)
    assert mixing.mix(empty, labels).count() == 0
    assert mixing.pipeline_stage(spark, docs, DATA).columns == docs.columns


def test_rates_against_plain_least_squares(spark):
    rng = np.random.default_rng(8)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 500, 200)
    frame = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p, strict=True)], "n long, p0 double, p1 double, p2 double")
    rate, reached, total = mixing.fit_rates(frame, [0.7, 0.25, 0.05])
    got = np.array([r[0] for r in frame.select(rate).collect()])
    assert (got >= 0).all() and np.allclose((got * n) @ p / n.sum(), [0.7, 0.25, 0.05], atol=1e-5) and np.allclose((got * n) @ p, reached) and total == n.sum()


def test_language_held_out(spark, docs, odd, empty):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    known = docs.where("doc_id % 2 = 0")
    rows = {r.doc_id: r for r in langid.identify(pages, docs, known).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id % 2 = 1").collect()}
    assert np.mean([rows[d].lang == lang for d, lang in truth.items()]) > 0.97
    assert len(rows) == docs.count() + pages.count()
    web = spark.createDataFrame([(1, "https://de.example.de/x", '<html lang="de"><p></p>'), (2, None, None), (3, "nonsense", "")], "page_id long, url string, html string")
    found = langid.identify(web, odd, docs).collect()
    assert len(found) == 3 + odd.count() and all(r.lang for r in found)
    assert langid.identify(web, empty).where("lang is not null").count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mixing", "bpe_encoding"]
    columns = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, DATA)
        assert after.columns == columns and dict(after.dtypes) == dict(now.dtypes)
        now = mixing.cut(after)
    out = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert out.count() == now.count() > 0


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    import corpus_pipeline

    for rows in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, DATA)
            assert name == "bpe_encoding" or out.columns == rows.columns
            assert out.count() <= 3 * max(1, rows.count())


def test_a_passage_that_a_document_repeats_is_whole_in_each_place(spark):
    passage = " ".join(f"shared{i}x" for i in range(50))
    own = lambda d, k: " ".join(f"own{d}q{k}w{i}" for i in range(70))
    docs = spark.createDataFrame(
        [(1, " ".join([own(1, 0), passage, own(1, 1), passage, own(1, 2), passage, own(1, 3)])), (2, f"{own(2, 0)} {passage} {own(2, 1)}")], "doc_id long, text string"
    )
    got = {(r.doc_id, r.first_word): (r.n_words, r.n_removed) for r in paragraphs.repeats(docs).collect()}
    starts = {(1, 70 + 120 * k) for k in range(3)} | {(2, 70)}
    assert set(got) == starts and all(n == 50 for n, _ in got.values())
    # the first place stays and the other document's goes; within a document only whole paragraphs go
    assert got[1, 70][1] == 0 and got[2, 70][1] == 50 and all(0 < got[1, 70 + 120 * k][1] <= 50 for k in (1, 2))


def test_long_lines_of_few_words_meet(spark):
    address = "https://example.com/a/rather/long/path/" + "".join(f"part{i}-" for i in range(10)) + "index.html"
    script = "".join(chr(0x3042 + i * 7 % 80) + chr(0x4E00 + i * 37) for i in range(45))
    two = "x" * 20 + "".join(f"q{i}z" for i in range(15)) + " " + "".join(f"w{i}k" for i in range(15))
    many = "-".join(f"token{i}" for i in range(900))
    made = []
    for k, line in enumerate((address, script, two, many)):
        at = len(line) // 2
        made += [(10 * k, line), (10 * k + 1, line[:at] + "é" + line[at + 1 :])]
    made.append((99, "https://example.org/" + "".join(chr(97 + i * 11 % 26) for i in range(90))))
    assert all(len(line) >= 80 for _, line in made)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert {d for d, t in out.items() if t == ""} == {1, 11, 21, 31}


def test_large_bucket_keeps_every_link(spark, monkeypatch):
    """Lines whose nearest SimHashes are of other lines, and lines with one SimHash: each true link is found."""
    words = [f"word{k:03d}" for k in range(60)]
    random.seed(21)

    def made(line):  # one SimHash, for the order of words is no part of it
        return [" ".join(line), " ".join(reversed(line))]

    base = random.sample(words, 40)
    near = [x for k in range(14) for x in made([*base[:36], *random.sample(words, 4)])]
    rows = [(i, t) for i, t in enumerate(near)]
    norm = [line_dedup.normal(t).decode() for _, t in rows]
    how = line_dedup.Edits()
    ready = [how.prepare(t) for t in norm]
    want = groups(len(rows), lambda i, j: norm[i] == norm[j] or how.same(ready[i], ready[j]))
    assert 1 < len(set(want)) < len(rows)
    for run in (2048, 5):
        monkeypatch.setattr(line_dedup, "RUN", run)
        got = line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.id for r in got.collect()} == {i for i, g in enumerate(want) if g != i}


def test_nearest_first_then_all_others():
    """Pairs within 22 bits that components do not join all go on, however large the bucket."""
    rng = np.random.default_rng(5)
    node = np.sort(np.unique(rng.integers(0, 1 << 20, 300)))
    bucket = np.zeros(len(node), np.int64)
    every = {frozenset(p) for p in zip(*(x.tolist() for x in line_dedup.Near(6).inside(bucket, node, [])), strict=True)}
    assert every == {frozenset((int(a), int(b))) for a in node for b in node if a != b and (int(a) ^ int(b)).bit_count() <= 6}
    comp = [str(int(x) % 3) if x % 4 else None for x in node]
    named = dict(zip(node.tolist(), comp, strict=True))
    some = {frozenset(p) for p in zip(*(x.tolist() for x in line_dedup.Near(6).inside(bucket, node, comp)), strict=True)}
    assert some == {p for p in every if len({named[x] for x in p}) > 1 or None in {named[x] for x in p}}


def test_long_lines_with_changed_letters_meet(spark):
    """One letter in ten changed, in whatever word: at least nine in ten of such pairs of long lines are found."""
    random.seed(31)
    letters, how, rows, want = "abcdefghijklmnopqrstuvwxyz", line_dedup.Edits(), [], set()
    for k in range(80):
        line = " ".join("".join(random.choice(letters) for _ in range(random.randint(2, 8))) for _ in range(random.randint(14, 60)))
        other = "".join(c if c == " " or random.random() >= 0.1 else random.choice(letters) for c in line)
        if len(line) >= line_dedup.MIDDLE and how.same(how.prepare(line), how.prepare(other)):
            rows += [(2 * k, line), (2 * k + 1, other)]
            want.add(2 * k + 1)
    got = {r.id for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 60 and got <= want and len(got) >= 0.9 * len(want)


def test_sketches_pass_every_pair_by_length_place_and_characters():
    """The exact parts of the gate: no edit that is allowed makes lengths, places or counts of characters differ too much."""
    random.seed(32)
    gate, how, n = line_dedup.Sketched(0.8), line_dedup.Edits(), 0
    for _ in range(3000):
        a = "".join(random.choice("abcdefgh ") for _ in range(random.randint(25, 79)))
        b = "".join(c if random.random() < 0.88 else random.choice(["", "x", c + "y"]) for c in a)
        if how.same(how.prepare(a), how.prepare(b)):
            x = np.zeros(2, line_dedup.SKETCH)
            x["more"], x["size"], x["at"] = [line_dedup.characters(t) for t in (a, b)], [len(a), len(b)], line_dedup.ANY
            n += 1
            assert gate.near(x[:1], x[1:])[1][0] and gate.counted(x[:1], x[1:])[0]
    assert n > 1000


def test_many_distances_at_once(spark, monkeypatch):
    """Pairs of different lines of one length are told apart together, not one by one, and exactly."""
    from sextant.llm import _edits

    random.seed(4)
    left, right = [], []
    for n in (1, 63, 64, 65, 128, 300):
        for alphabet in ("ab", "abcdefgh ", "añ漢字𝒳 bc"):
            for share in (0, 0.1, 0.19, 0.21, 0.4, 1):
                for _ in range(6):
                    a = random.choices(alphabet, k=n + random.randint(0, 2))
                    b = [random.choice(alphabet) if random.random() < share else c for c in a]
                    at = random.randrange(len(b))
                    left.append("".join(a))
                    right.append("".join(b[:at] + b[at + 1 :] if random.random() < 0.5 else b[:at] + random.choices(alphabet, k=2) + b[at:]))
    most = [int(0.2 * max(len(a), len(b))) for a, b in zip(left, right, strict=True)]
    want = [line_dedup.distance(a, b) <= k for a, b, k in zip(left, right, most, strict=True)]
    for few, check in ((1, 5), (32, 48)):
        monkeypatch.setattr(_edits, "FEW", few)
        monkeypatch.setattr(_edits, "CHECK", check)
        assert _edits.within(left, right, most).tolist() == want and 0.2 < sum(want) / len(want) < 0.8
    lines = ["".join(random.choices("abcdefghij ", k=200)) for _ in range(600)]
    how, asked = line_dedup.Edits(), []
    monkeypatch.setattr(_edits, "distance", lambda a, b, most: asked.append(a) or 0)
    ready = [how.prepare(x) for x in lines]
    assert not how.all_same(ready[:300], ready[300:]).any() and not asked
