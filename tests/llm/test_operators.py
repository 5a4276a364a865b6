import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD

from gaugeline.llm import attention_lm, bpe, decontaminate, langid, lines, quality, shards, simhash, substrings, warc, wordstream

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_word_hashes_are_those_of_the_words():
    texts = [b"one two  one", b"", b"two\tone two one", "é one".encode()]
    w = wordstream.Words(texts)
    assert [w.word(i) for i in range(len(w.starts))] == [x for t in texts for x in t.split()]
    by = defaultdict(set)
    for i, h in enumerate(w.hashes):
        by[w.word(i)].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    at, h = w.windows(2)
    assert len(at) == 2 + 3 + 1 and len(set(h.tolist())) == 3


# 1 ------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return len(b) - len(a) <= 1 and a[k + (len(a) == len(b)) :] == b[k + 1 :]


@pytest.mark.parametrize("broadcast_rows", [300_000, 0])
def test_lines_against_brute_force(docs, prose, broadcast_rows):
    base = [prose(12, s) for s in range(6)] + ["tiny"]
    pairs = []
    for i in range(40):
        t = base[i % 7]
        k = (i * 7) % len(t)
        pairs.append((100 - i, "\n".join([prose(8, 50 + i), t, t[:k] + "Q" + t[k:] if i % 3 else t[:k] + t[k + 1 :], "", base[(i + 1) % 7]])))
    pairs += ODD
    got = {r["doc_id"]: r for r in lines.report(docs(pairs), broadcast_rows=broadcast_rows).collect()}
    occurrences = sorted({(i, p, x) for i, t in pairs if i is not None for p, x in enumerate((t or "").split("\n")) if SPACED.search(x)})
    first = {}
    for i, p, x in occurrences:
        first.setdefault(x, (i, p))
    near = {x for x in first if len(x) >= 20 and any(len(y) >= 20 and first[y] < first[x] and one_edit(x, y) for y in first)}
    assert near
    for i, t in pairs:
        if i is None or (i == 4):
            continue
        gone = [p for p, x in enumerate((t or "").split("\n")) if SPACED.search(x) and ((i, p) > first[x] or x in near)]
        assert got[i]["n_equal"] + got[i]["n_near"] == len(gone)
        assert got[i]["kept_sha256"] == sha("\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone))
    assert got[None]["n_equal"] == 0
    twice = [(5, f"{prose(9, 1)}\n{prose(9, 2)}"), (5, f"{prose(9, 1)}\n{prose(9, 3)}"), (-7, prose(9, 4)), (9, "x" * 60000 + "\n" + prose(9, 4))]
    got = {r["text"] for r in lines.dedup(docs(twice), broadcast_rows=broadcast_rows).collect()}
    assert prose(9, 4) in got and "x" * 60000 in got and Counter(x for t in got for x in t.split("\n"))[prose(9, 1)] == 1
    assert {prose(9, 2), prose(9, 3)} <= {x for t in got for x in t.split("\n")}
    kept = lines.dedup(docs(pairs))
    assert kept.columns == docs([]).columns and lines.report(docs([])).count() == 0


# 2 ------------------------------------------------------------------------------------------------------


def test_quality_counts_and_verdicts(docs, prose):
    clean = [(100 + i, prose(60 + i % 40, i)) for i in range(200)]
    junk = [(1000 + i, " | ".join(prose(80, i).upper().split())) for i in range(5)]
    repeats = [(2000, "same eight words in a row here now " * 10)]
    data = clean + junk + repeats + ODD
    got = defaultdict(list)
    for r in quality.reject_outliers(docs(data), min_cell=50).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(data)
    for i, t in data:
        w = SPACED.findall(t or "")
        runs = [tuple(w[p : p + 8]) for p in range(len(w) - 7)]
        times = Counter(runs)
        again = {q for p, x in enumerate(runs) if times[x] > 1 for q in range(p, p + 8)}
        worded = [x for x in (t or "").split("\n") if SPACED.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(worded) - len(set(worded)), len(again))
        r = got[i][0]
        assert tuple(r)[1:6] == expected and r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert all(got[i][0]["kept"] for i, _ in clean) and not any(got[i][0]["kept"] for i, _ in junk + repeats)
    assert quality.reject_outliers(docs([])).count() == 0
    assert quality.keep_good(docs(data), min_cell=50).columns == docs([]).columns


def test_estimates_are_robust(docs, prose):
    """A tenth of junk doesn't move the cell so far that it is taken for clean."""
    data = [(i, prose(80, i)) for i in range(180)] + [(500 + i, "$ ".join(prose(80, i).split())) for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.reject_outliers(docs(data), min_cell=50).collect()}
    assert all(got[i] for i in range(180)) and not any(got[500 + i] for i in range(20))


def test_the_least_determinant_is_found(spark):
    """Cells of known shape, some with clusters: the determinant is not over
    that of the best of 200 random starts by plain concentration."""
    rng = np.random.default_rng(3)
    p, h = len(quality.FEATURES), 0.6
    cells = {"plain": rng.normal(3, 1, (300, p)), "cluster": np.concatenate((rng.normal(3, 1, (210, p)), rng.normal(9, 0.05, (90, p)))), "junk": np.concatenate((rng.normal(3, 1, (240, p)), rng.normal(9, 1, (60, p)))), "constant": np.full((60, p), 2.0)}
    rows = spark.createDataFrame([(c, *map(float, r)) for c, x in cells.items() for r in x], "cell string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    names = sorted(cells)
    got = quality.least_determinant(quality.Cells(rows, names), h)
    least = np.diag(np.array(list(quality.FEATURES.values())) ** 2)

    def steps(x, subset):
        for _ in range(30):
            mean, cov = x[subset].mean(0), np.cov(x[subset].T, bias=True) + least
            off = x - mean
            subset = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))[: int(np.ceil(h * len(x)))]
        return np.linalg.slogdet(np.cov(x[subset].T, bias=True) + least)[1]

    for c, x in cells.items():
        best = min(steps(x, rng.choice(len(x), p + 1, replace=False)) for _ in range(200))
        assert got.logdet[names.index(c), 0] <= best + 0.15
    assert np.allclose(got.mean[names.index("junk"), 0], 3, atol=0.5)


def test_pools_and_repeated_ids(docs, prose):
    """Junk of a rare source, of a rare language, and among rows of one id or of none, is judged by what it is pooled with."""
    junk = lambda s: " | ".join(prose(80, s).upper().split())
    good = docs([(i, prose(60 + i % 40, i)) for i in range(120)])
    rare = docs([(500, prose(70, 1)), (501, junk(1))], source="rare").union(docs([(600, junk(2)), (601, prose(75, 4))], lang="xx", source=None))
    mixed = docs([(700, prose(70, 9)), (700, junk(3)), (None, prose(71, 8)), (None, junk(4))], lang=None)
    every = good.union(rare).union(mixed).union(docs(ODD, lang="", source=""))
    got = Counter((r["doc_id"], r["kept"]) for r in quality.reject_outliers(every).collect())
    for i in (500, 601, 700, None):
        assert got[(i, True)] == 1
    for i in (501, 600, 700):
        assert got[(i, False)] == 1
    kept = Counter(r["doc_id"] for r in quality.keep_good(every).collect())
    assert kept == Counter({i: n for (i, ok), n in got.items() if ok}) and kept[700] == 1 and kept[None] == 1
    joined = Counter(r["doc_id"] for r in quality.keep_good(every, most_cells=3).collect())  # in parts, and by a join
    assert joined == kept and quality.keep_good(docs([])).count() == 0


# 3 ------------------------------------------------------------------------------------------------------


def test_bit_slices_against_counting():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**63, 700, dtype=np.uint64)
    f[1::3] = f[::3][: len(f[1::3])] ^ (np.uint64(1) << rng.integers(0, 63, len(f[1::3])).astype(np.uint64))
    planes = simhash.Planes(f)
    for radius in (1, 2, 5, 30):
        for shift in (1, 2, 7, 8, 9, 64, 300, 699):
            true = np.flatnonzero(np.bitwise_count(f[:-shift] ^ f[shift:]) <= radius)
            assert planes.within(shift, radius, np.arange(700) < 700 - shift).tolist() == true.tolist()


@pytest.mark.parametrize("tile", [4096, 8])
def test_simhash_groups_against_brute_force(docs, prose, tile):
    import xxhash

    base = [prose(60, s) for s in range(30)]
    pairs = [(i, base[i % 30] + (f" extra{i}" if i % 4 == 0 else "")) for i in range(100, 220)] + ODD
    got = simhash.near_groups(docs(pairs), tile=tile).collect()
    prints = {}
    for i, t in pairs:
        w = SPACED.findall((t or "").translate(LOWER))
        grams = [" ".join(w[p : p + 3]) for p in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    groups = {i: i for i in prints if i is not None}
    changed = True
    while changed:
        changed = False
        for a in groups:
            for b in groups:
                if groups[b] > groups[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    groups[b], changed = groups[a], True
    assert len(got) == len(pairs) and any(groups[i] != i for i in groups)
    for r in got:
        if r["doc_id"] is not None:
            assert (int(r["fingerprint"], 16), r["component_id"]) == (prints[r["doc_id"]], groups[r["doc_id"]])
    assert simhash.near_groups(docs([])).count() == 0


def test_near_dedup_keeps_one_of_each_group(docs, prose):
    base = [prose(100, s) for s in range(20)]
    edited = lambda t, k: " ".join(x if j != k else "changed" for j, x in enumerate(t.split()))
    pairs = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t, 50)) for i, t in enumerate(base)] + [(200 + i, t) for i, t in enumerate(base)]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(pairs)).collect()}
    assert kept == set(range(20))


def kept_by_brute_force(pairs, k=5, similarity=0.8):
    """The least id of each component of all pairs at the similarity or more, and how many pairs there are."""
    sets = {i: {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set() for i, t in pairs for w in [(t or "").translate(LOWER).split()]}
    least, links, by = {i: i for i in sets}, 0, defaultdict(list)
    for i, s in sets.items():
        for x in s or {None}:
            by[x].append(i)
    for a, b in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        both = len(sets[a] & sets[b])
        if not sets[a] and not sets[b] or both >= similarity * (len(sets[a]) + len(sets[b]) - both) and both:
            links += 1
            x, y = sorted((least[a], least[b]))
            if x != y:
                least = {i: x if m == y else m for i, m in least.items()}
    return set(least.values()), links


@pytest.mark.parametrize("tile", [4096, 30])
def test_near_dedup_among_false_partners_against_brute_force(docs, prose, tile):
    """Many documents share a passage and are 0.6 to 0.79 alike; the true pairs stand among them."""
    passage = prose(150, 1)
    own = {i: prose(30 + i % 10, 100 + i).split() for i in range(120)}
    for i in range(20, 40):
        own[i + 60] = own[i][:-2] + ["other", f"end{i}"]
    pairs = [(i, passage + " " + " ".join(w)) for i, w in own.items()]
    least, links = kept_by_brute_force(pairs)
    assert len(least) == 100 and links == 20
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(pairs), words=2, band=2, tile=tile).collect()}  # wide buckets
    assert kept == least


def test_near_dedup_of_templated_texts(docs, prose):
    """A template at 0.73 between any two, and a copy of each at 0.95 or more."""
    template, data = prose(150, 3, 5000), []
    for i in range(150):
        own = prose(24, 1000 + i, 5000).split()
        data += [(i, f"{template} {' '.join(own)}"), (1000 + i, f"{template} {' '.join(own[:12] + ['edited'] + own[13:])}")]
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs(data)).select("doc_id").collect()} == set(range(150))


def test_exact_pairs_finds_all_and_sends_on_few(spark, prose):
    """Parts of one text that share its rarest shingles, few of them alike: every pair at 0.8 leaves the join, and few others."""
    words, rng = prose(400, 7, 5000).split(), np.random.default_rng(2)
    data = []
    for i in range(60):
        a = int(rng.integers(0, 200))
        data.append((i, " ".join(words[a : a + 100 + int(rng.integers(0, 100))])))
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in data}
    share = {(b, a): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    alike = {p for p, j in share.items() if j >= 0.8}
    rows = spark.createDataFrame([(i, i, t) for i, t in data], "node long, known long, text string")
    got = {(r["u"], r["v"]) for r in simhash.exact_pairs(rows, 5, 0.8).collect()}
    assert alike and alike <= got and len(got) <= 1.2 * sum(j >= 0.75 for j in share.values())
    assert simhash.exact_pairs(rows.limit(0), 5, 0.8).count() == 0


def test_near_dedup_on_a_table_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in rows.collect()]
    least, links = kept_by_brute_force(data)
    assert links and {r["doc_id"] for r in simhash.drop_near_duplicates(rows).select("doc_id").collect()} == least


def test_near_dedup_of_odd_rows(docs, prose):
    """Rows without an id stay; a row repeated whole stays repeated; rows of one id are judged by their own texts."""
    long = prose(40, 1)
    data = [*ODD, (50, long), (51, long), (50, prose(40, 2)), (60, prose(40, 2)), (70, "x y " * 20000), (71, "x y " * 20000)]
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs(data)).collect())
    assert kept[(None, "no id here at all")] == 1 and kept[(4, "one")] == 2 and kept[(50, long)] == 1 and kept[(50, prose(40, 2))] == 1
    assert {i for i, _ in kept} == {None, 1, 4, 5, 6, 7, 50, 70}  # texts without a word are one group
    assert simhash.drop_near_duplicates(docs([])).count() == 0


def test_all_rows_against_a_block_of_them():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**63, (300, 4), dtype=np.uint64)
    f[1::3] = f[::3] ^ (np.uint64(1) << rng.integers(0, 63, (100, 4)).astype(np.uint64))
    far = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    np.fill_diagonal(far, 999)
    bits = np.unpackbits(f.view(np.uint8).reshape(300, -1), axis=1, bitorder="little").T
    wide = np.zeros((256, 320), np.uint8)
    wide[:, :300] = bits
    for radius in (2, 4, 9, 100, 120, 140):
        got = simhash.within_all(np.packbits(wide, axis=1, bitorder="little").view(np.uint64), (-bits.astype(np.int64)).view(np.uint64), radius)[:, :300]
        np.fill_diagonal(got, False)
        assert (got == (far <= radius)).all()
    hits = far <= 120
    for found in (simhash.nearest, simhash.hit_rows):
        rows = [x for r in found(np.zeros(300, int), f, 120, np.full(300, 2), np.arange(300)) for x in zip(*map(np.ndarray.tolist, r))]
        named = defaultdict(set)
        for i, j, d, more in rows:
            assert d == far[i, j] <= 120 and more == (hits[i].sum() > 2)
            named[i].add(j)
        for i in range(300):
            true = set(np.flatnonzero(hits[i]).tolist())
            assert named[i] <= true and (len(true) > 2 or named[i] == true)
            assert not true or (min(true) in named[i] and far[i][list(named[i])].min() == far[i].min())


def test_components_of_a_chain_and_a_star(spark):
    from gaugeline.llm.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# 4 ------------------------------------------------------------------------------------------------------


def test_language(docs):
    words = {"en": "the quick brown fox jumps over the lazy dog and then some of this".split(), "de": "der schnelle braune fuchs springt über den faulen hund und dann noch mehr".split()}
    rng = np.random.default_rng(0)
    data = docs([], parts=1)
    for lang, v in words.items():
        data = data.union(docs([(i + (1000 if lang == "de" else 10), " ".join(rng.choice(v, 30))) for i in range(60)], lang))
    data = data.union(docs(ODD, None))
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    got = defaultdict(list)
    for r in langid.identify(data, out).collect():
        got[r["doc_id"]].append(r)
    for i in range(60):
        assert got[10 + i][0]["lang_pred"] == "en" and got[1000 + i][0]["lang_pred"] == "de"
        assert got[10 + i][0]["held_out"] == (zlib.crc32(str(10 + i).encode()) % 3 == 1) and 0 <= got[10 + i][0]["score"] <= 1
    assert [got[i][0]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and len(got[4]) == 2
    assert {r["lang_pred"] for r in langid.identify(docs(ODD, None), out).collect()} == {"und"}


def test_distance_against_brute_force():
    """Out-of-place distances by plain counting of strings."""

    def ranked(text, size):
        t = " " + re.sub(r"[^a-zé]+", " ", text.lower()).strip() + " "
        n = Counter(t[p : p + k] for k in (1, 2, 3) for p in range(len(t) - k + 1) if t[p : p + k] != " " and t[p : p + k][1:-1] != " ")
        code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return sorted(map(code, n), key=lambda g: (-n[next(x for x in n if code(x) == g)], g))[:size]

    teach = {"a": "the cat sat on the mat and the hat", "b": "der hund und die katze, élan"}
    size = 30
    known = langid.Profiles([(lang, np.array(g, np.uint64).view(np.int64).item(), p) for lang, t in teach.items() for p, g in enumerate(ranked(t, size))], size)
    for text in ("the hat on the cat", "die katze und der élan", "zzz qq", "Hund! the"):
        own, best = ranked(text, size), {}
        for lang, t in teach.items():
            place = {g: p for p, g in enumerate(ranked(t, size))}
            best[lang] = sum(min(abs(place[g] - p), size) if g in place else size for p, g in enumerate(own))
        lang = min(best, key=lambda x: (best[x], x))
        got, score = known.predict(text.encode())
        assert (got, score) == (lang, pytest.approx(1 - best[lang] / (size * len(own))))


def test_profile_is_by_rank():
    got = langid.profile(b"aab aab", 5)
    g, n = langid.grams(b"aab aab")
    assert len(got) == 5 and [int(n[g == x][0]) for x in got] == sorted((int(n[g == x][0]) for x in got), reverse=True)


# 5 ------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, prose):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = ["a<|endoftext|> b <|endoftext|>" * 30, "   " * 400, "y" * 5000, "你好 世界 " * 200, "é ü   " * 300, "a  b   c \n d " * 300, "1 2 3 4 " * 400, prose(3000), "it's we'll I'd  " * 200]
    pairs = [(100 + i, t) for i, t in enumerate(odd)] + ODD
    for ranks in (P.path("byte_bpe_50k.tiktoken"), None):
        for r in bpe.encode_decode(docs(pairs), P.path("byte_bpe_50k.json"), ranks, with_ids=True, bits=3, store=20_000).collect():
            t = next(t or "" for i, t in pairs if i == r["doc_id"])
            ids = library.encode(t, add_special_tokens=False).ids
            assert list(r["ids"]) == ids and r["decoded"] == t and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == sha(",".join(map(str, ids))) and r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_both_engines_agree_below_the_limit():
    codec = bpe.Codec(*(open(P.path(f"byte_bpe_50k.{x}"), "rb").read() for x in ("json", "tiktoken")))
    for c in range(0x250):
        for pattern in ("a{}b", "a {} b", "{0}{0} 1", "x \n{}\n y", "'{}s"):
            t = pattern.format(chr(c))
            assert codec.fast.encode_ordinary(t) == codec.slow.encode(t, add_special_tokens=False).ids


def test_a_wrong_join_is_repaired():
    codec = bpe.Codec(*(open(P.path(f"byte_bpe_50k.{x}"), "rb").read() for x in ("json", "tiktoken")))
    e, text = bpe.Encoder(codec), b"some longer words interconnected here and there"
    cut = text.index(b"connected")
    got = e._join(text, list(e.chunk(text[:cut])), e.chunk(text[cut:]), cut, len(text))
    assert got == codec.encode(text.decode()) and e.repaired
    e.encode(text * 50)
    before = e.encoded
    e.encode(text * 50)
    assert e.encoded == before and e.reused


# 6 ------------------------------------------------------------------------------------------------------


def test_gradient_against_differences():
    shape = attention_lm.Shape(classes=5, dim=4, buckets=11, hop=4)
    rng = np.random.default_rng(0)
    flat = shape.start() * 2
    inputs, goal = rng.integers(0, 50, (3, 8)), rng.integers(0, 5, (3, 4))
    seen, counted = np.ones((3, 8), np.float32), np.ones((3, 4), np.float32)
    seen[0, :4] = 0
    counted[1, 3] = 0
    _, g = attention_lm.gradient(shape, shape.unpack(flat), inputs, seen, goal, counted)
    loss = lambda x: attention_lm.gradient(shape, shape.unpack(x), inputs, seen, goal, counted)[0]
    for k in rng.integers(0, len(flat), 25):
        step = np.zeros_like(flat)
        step[k] = 1e-2
        assert (loss(flat + step) - loss(flat - step)) / 2e-2 == pytest.approx(g[k], abs=3e-3)


def test_gradient_of_hops_is_that_of_their_windows():
    shape = attention_lm.Shape(classes=9, dim=4, buckets=11, hop=4)
    rng = np.random.default_rng(0)
    inputs, goal, fresh = rng.integers(0, 50, (7, 4)), rng.integers(0, 9, (7, 4)), np.isin(np.arange(7), (0, 1, 4))
    counted = (rng.random((7, 4)) < 0.8).astype(np.float32)
    p = shape.unpack(shape.start() * 2)
    windows = np.concatenate((np.concatenate((inputs[:1], inputs[:-1])), inputs), 1)
    seen = np.repeat(np.stack((~fresh, np.ones(7, bool)), 1), 4, 1).astype(np.float32)
    loss, g = attention_lm.gradient(shape, p, windows, seen, goal, counted)
    got, own = attention_lm.hop_gradient(shape, p, inputs, fresh, goal, counted)
    assert got == pytest.approx(loss, abs=1e-5) and np.allclose(own, g, atol=1e-5) and np.abs(g).max() > 0.05


@pytest.mark.parametrize("most", [400_000, 5])
def test_all_training_text_is_learned_from(docs, spark, prose, most):
    """Each subword and each end of each text is a target once, in the window that scoring sees it in."""
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    sub, shape = attention_lm.Subwords(data, attention_lm.PATTERN), attention_lm.Shape(hop=4)
    pairs = [(i, prose(n, i)) for i, n in ((20, 1), (21, 37), (22, 3000), (23, 2500))] + [(24, prose(2500, 23))] + ODD
    hop, want, words, ids_of_all = shape.hop, Counter(), Counter(), Counter()
    for _, t in pairs:
        w = SPACED.findall((t or "").translate(LOWER))
        words.update(w)
        ids = [*sub.spell(w)[0].tolist(), sub.end]
        ids_of_all.update(ids)
        full = [sub.end, *ids]
        for k in range(len(ids)):
            want[(*full[max(0, k // hop - 1) * hop : k + 1], ids[k])] += 1
    sent = spark.sparkContext.broadcast((data, attention_lm.PATTERN))
    gathered = docs(pairs).select("doc_id", "text").mapInArrow(attention_lm._gather(sent, hop, 3, 100, most), "kind int, word string, n long, ids binary").cache()
    rows = gathered.collect()
    counts = Counter()
    for r in rows:
        if r["kind"] == attention_lm.WORD:
            counts[r["word"]] += r["n"]
    assert counts == words and sum(r["n"] for r in rows if r["kind"] == attention_lm.TEXTS) == len(pairs)
    cuts = [r for r in rows if r["ids"] is not None]
    ids = [np.frombuffer(r["ids"], sub.kind) for r in cuts]
    inputs, fresh, goal, counted = attention_lm.lay(shape, np.concatenate(ids), np.array([len(i) for i in ids]), np.array([r["kind"] == attention_lm.GOES_ON for r in cuts]), sub.end)
    got = Counter()
    for h, i in np.argwhere(counted > 0):
        before = [] if fresh[h] else inputs[h - 1].tolist()
        got[(*before, *inputs[h, : i + 1].tolist(), int(goal[h, i]))] += 1
    assert got == want
    # and so is what stands beside what, in runs of four hops of targets
    size = sub.size
    tokens = np.array([ids_of_all[i] for i in range(size)])
    near = attention_lm.beside(gathered.filter("ids is not null"), tokens, sub.starts, sub.kind, hop, 3)
    chosen = np.flatnonzero(sub.starts)
    chosen = chosen[np.argsort(-tokens[chosen], kind="stable")][:3]
    brute = np.zeros((size, 3))
    for _, t in pairs:
        ids = np.append(sub.spell(SPACED.findall((t or "").translate(LOWER)))[0], sub.end)
        for a in range(0, len(ids), 3 * hop):  # a stretch of three hops is shorter than four
            part = ids[a : a + 3 * hop]
            part = part[sub.starts[part]]
            for x in part:
                brute[x] += [(part == c).sum() - (x == c) for c in chosen]
    assert (near == brute).all()


def test_words_are_numbered_a_block_at_a_time(prose):
    """Blocks of texts in arrays give the numbers that a dict gives word by word: odd bytes, all lengths, growth."""
    import pyarrow as pa

    odd = [b"", b" \t\n", b"a\x00 a a\x00\x00 \x00", "é\u00a0x É \u2028".encode(), b"x\xff\xfe y", b"A a" + b"z" * 40, *(b"q" * k + b" " + b"q" * k + b"\x00" for k in range(14, 19))]
    blocks = [odd, [prose(3000, 1).encode(), b""], odd[::-1], [prose(9000, 2).encode().upper()], [b"", b"\n"]]
    numbers, known = {}, attention_lm.Vocabulary()
    for texts in blocks:
        words = [t.translate(wordstream.LOWER).split() for t in texts]
        spread = attention_lm.Spread(texts)
        assert spread.n.tolist() == [len(w) for w in words] and [spread.word(i) for i in range(len(spread.size))] == sum(words, [])
        assert spread.names(np.arange(len(spread.size))).to_pylist() == sum(words, [])
        got = known.find(spread)
        assert got.tolist() == [numbers.get(w, -1) for w in sum(words, [])]
        new = [w for w in dict.fromkeys(sum(words, [])) if w not in numbers]
        known.put(spread.pick(np.array([sum(words, []).index(w) for w in new], np.int64)))
        numbers.update({w: len(numbers) + i for i, w in enumerate(new)})
        assert known.find(spread).tolist() == [numbers[w] for w in sum(words, [])] and known.n == len(numbers)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    sub = attention_lm.subwords(data, attention_lm.PATTERN)
    assert sub is attention_lm.subwords(data, attention_lm.PATTERN)  # not parsed again by a worker's next task
    for names in (list(numbers), [b"a", b"b\xc2\xa0", b"c"], []):
        got, want = sub.spell_names(pa.array(names, pa.large_binary())), sub.spell([w.decode("utf-8", "replace") for w in names])
        assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_frequent_words_do_not_overflow_their_counts(docs, spark):
    """One word all over a block of texts: more than 65,535 neighbours in one sum."""
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    sub, sent = attention_lm.Subwords(data, attention_lm.PATTERN), spark.sparkContext.broadcast((data, attention_lm.PATTERN))
    (a, b), n = sub.spell(["the", "and"])[0].tolist(), 64 * 1100
    rows = docs([(1, "the " * (n - 64) + "and " * 63)]).select("doc_id", "text").coalesce(1).mapInArrow(attention_lm._gather(sent, 16), "kind int, word string, n long, ids binary")
    tokens = np.bincount([a] * 3 + [b] * 2 + [sub.end], minlength=sub.size)
    near = attention_lm.beside(rows.filter("ids is not null"), tokens, sub.starts, sub.kind, 16, 2)
    assert near[a].tolist() == [(n - 64) * 63, 0] and near[b].tolist() == [0, 63 * 62] and near[sub.end].tolist() == [0, 63]


def small_model(near=None):
    shape = attention_lm.Shape(hop=4, dim=4, buckets=64, classes=16)
    starts = np.arange(100) % 3 == 0
    class_of, share = attention_lm.token_classes(np.arange(100.0), starts, shape, near)
    return starts, attention_lm.Model(shape, shape.start(), class_of, share.astype(np.float32))


@pytest.mark.parametrize("near", [None, np.random.default_rng(1).integers(0, 9, (100, 5)).astype(float)])
def test_scores_are_causal_and_whole(near):
    starts, m = small_model(near)
    mass = np.bincount(m.class_of, np.exp(m.share), m.shape.classes)
    assert np.allclose(mass[mass > 0], 1) and ((m.class_of >= m.shape.inside) == starts).all()
    ids = np.random.default_rng(0).integers(0, 99, 23)
    texts = [ids, ids[:9], ids[:1]]
    each = lambda t: m.log_prob(t, np.array([len(t)]), 99)[0]
    whole = m.log_prob(np.concatenate(texts), np.array([23, 9, 1]), 99)
    assert np.allclose(whole, [each(t) for t in texts]) and np.allclose(m.log_prob(ids, np.array([23]), 99, rows=2), whole[0])
    assert each(ids) < each(ids[:-1]) < 0
    for some in (np.flatnonzero(starts), np.flatnonzero(~starts)):  # one distribution for starts, one for others
        after = [each(np.append(ids[:7], i)) - each(ids[:7]) for i in some]
        assert np.exp(after).sum() == pytest.approx(1, abs=1e-3)


def test_lexicon_is_a_distribution_over_spellings():
    """At known, unknown and last subwords, ends and goings-on have the mass one, whatever the model adds."""
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        sub = attention_lm.Subwords(f.read(), attention_lm.PATTERN)
    words = ["bleores", "bleore", "blewhorly", "thwhorly", "thattish", "é\u00a0x", "\u00a0", "x" * 300]
    lexicon = attention_lm.Lexicon.of_words(words, np.array([5, 1, 2, 9, 1, 1, 1, 1]), sub)
    ids, first = sub.spell(words)
    assert [sub.encoding.decode(ids[a:b].tolist()) for a, b in zip(first, first[1:])] == [" " + w for w in words]
    inside = np.flatnonzero(~sub.starts)
    for stem in (sub.spell(["bleores"])[0], sub.spell(["blewhor"])[0][:3], sub.spell(["blewhor"])[0][:2], sub.spell(["zebra, zq"])[0][:1]):
        _, _, stop = lexicon.walk(stem, np.array([0, len(stem)]))
        more = np.concatenate([np.append(stem, i) for i in inside])
        direct, back, _ = lexicon.walk(more, np.arange(len(inside) + 1) * (len(stem) + 1))
        at = np.arange(1, len(inside) + 1) * (len(stem) + 1) - 1
        assert np.exp(stop[0]) + direct[at].sum() + back[at].mean() == pytest.approx(1)
        assert np.ptp(back[at]) < 1e-12 and 0 < np.exp(stop[0]) < 1
    empty = attention_lm.Lexicon.of_words([], np.zeros(0), sub)
    assert np.isfinite(empty.walk(ids, first)[2]).all() and (empty.walk(ids, first)[0] == 0).all()


@pytest.mark.parametrize("most", [1 << 19, 6])
def test_the_lexicon_of_a_table_is_that_of_its_words(spark, most):
    """All nodes kept: as of the words at hand. Few kept: still a distribution at every node."""
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    sub = attention_lm.Subwords(data, attention_lm.PATTERN)
    words = [("bleores", 5), ("bleore", 1), ("blewhorly", 2), ("thwhorly", 9), ("thattish", 1), ("thattishly", 3)]
    sent = spark.sparkContext.broadcast((data, attention_lm.PATTERN))
    got, tokens = attention_lm.learn_words(spark.createDataFrame(words, "word string, n long").repartition(3), sent, sub.size, most, most)
    ids, first = sub.spell([w for w, _ in words])
    assert (tokens == np.bincount(ids, np.repeat([n for _, n in words], np.diff(first)), sub.size)).all()
    if most > 10:
        whole = attention_lm.Lexicon.of_words([w for w, _ in words], [n for _, n in words], sub)
        assert all(np.allclose(a, b) for a, b in zip(got.walk(ids, first), whole.walk(ids, first), strict=True))
    inside = np.flatnonzero(~sub.starts)
    for a, b in zip(first, first[1:], strict=False):
        for stem in (ids[a : a + 1], ids[a : b - 1] if b - a > 2 else ids[a:b]):
            stop = got.walk(stem, np.array([0, len(stem)]))[2]
            more = np.concatenate([np.append(stem, i) for i in inside])
            direct, back, _ = got.walk(more, np.arange(len(inside) + 1) * (len(stem) + 1))
            at = np.arange(1, len(inside) + 1) * (len(stem) + 1) - 1
            assert np.exp(stop[0]) + direct[at].sum() + back[at].mean() == pytest.approx(1)


def test_no_node_is_left_out_of_the_spelling(spark):
    """Whatever is sent or joined: words of the table and others as by the whole tree, one by one and as a table."""
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    sub = attention_lm.Subwords(data, attention_lm.PATTERN)
    words = [("bleores", 5), ("bleore", 1), ("blewhorly", 2), ("thwhorly", 9), ("thattish", 1), ("thattishly", 3)]
    sent = spark.sparkContext.broadcast((data, attention_lm.PATTERN))
    whole = attention_lm.Lexicon.of_words([w for w, _ in words], [n for _, n in words], sub)
    asked = [*(w for w, _ in words), "bleor", "thatthat", "\u00e9\u00a0x", "x" * 50]
    ids, first = sub.spell(asked)
    wanted = whole.walk(ids, first)
    for most in (0, 6, 1 << 19):
        got, _ = attention_lm.learn_words(spark.createDataFrame(words, "word string, n long").repartition(3), sent, sub.size, most, most)
        assert all(np.allclose(a, b) for a, b in zip(got.walk(ids, first), wanted, strict=True))
        table = {r["word"]: r for r in got.of(spark.createDataFrame([(w,) for w in asked], "word string")).collect()}
        assert len(table) == len(asked)
        for i, w in enumerate(asked):
            assert np.allclose(table[w]["direct"], wanted[0][first[i] : first[i + 1]]) and np.allclose(table[w]["back"], wanted[1][first[i] : first[i + 1]])
            assert table[w]["stop"] == pytest.approx(wanted[2][i])


def test_rare_words_are_scored_as_common_ones(docs, prose):
    """What tasks know beforehand makes no difference to any score."""
    pairs = [(i, prose(50, i, 30)) for i in range(20, 60)] + [(100, "zebra zebra quux zebra"), (101, "")]
    out = F.pmod(F.col("doc_id"), F.lit(7)) == 2
    scores = [{r["doc_id"]: r["score"] for r in attention_lm.score(docs(pairs), out, P.path("byte_bpe_50k.tiktoken"), bpe.PATTERN, top=top, rounds=0).collect()} for top in (1 << 18, 3, 0)]
    assert scores[0] == pytest.approx(scores[1]) and scores[0] == pytest.approx(scores[2])


def test_scores_are_those_of_the_forward_pass():
    """Window by window with ``forward``: the second hop of each window, each token once."""
    _, m = small_model()
    hop, ids = m.shape.hop, np.random.default_rng(5).integers(0, 99, 22)
    n = -(-len(ids) // hop) * hop
    seen = np.concatenate((np.zeros(hop), np.ones(n))).astype(np.float32)
    inputs = np.concatenate((np.full(hop + 1, 99), ids, np.full(n, 99)))[: hop + n]
    goal = np.concatenate((ids, np.full(n - len(ids), 99)))
    total = 0.0
    for s in range(0, n, hop):
        z, _ = attention_lm.forward(m.shape, m.shape.unpack(m.flat), inputs[None, s : s + 2 * hop], seen[None, s : s + 2 * hop])
        for i in range(min(hop, len(ids) - s)):
            c = m.class_of[goal[s + i]]
            of = (np.arange(m.shape.classes) >= m.shape.inside) == (c >= m.shape.inside)
            total += z[0, i, c] - np.log(np.exp(z[0, i][of]).sum()) + m.share[goal[s + i]]
    assert m.log_prob(ids, np.array([len(ids)]), 99)[0] == pytest.approx(total, abs=1e-3)


def test_averages_in_a_tree(spark):
    rng = np.random.default_rng(0)
    flat, n = rng.normal(size=(50, 7)).astype("<f4"), rng.integers(1, 9, 50)
    rows = spark.createDataFrame([(int(k), bytearray(f.tobytes())) for k, f in zip(n, flat, strict=True)], "n long, flat binary").repartition(5)
    got = rows.mapInArrow(attention_lm._average, "n long, flat binary").coalesce(1).mapInArrow(attention_lm._average, "n long, flat binary").collect()
    assert len(got) == 1 and got[0]["n"] == n.sum()
    assert np.allclose(np.frombuffer(got[0]["flat"], "<f4"), (flat * n[:, None]).sum(0) / n.sum(), atol=1e-5)


@pytest.mark.parametrize("top", [1 << 18, 3])
def test_lm_base_scores_against_brute_force(docs, prose, top):
    import math

    pairs = [(i, prose(50, i, 30)) for i in range(20, 70)] + ODD
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: SPACED.findall((t or "").translate(LOWER))
    c = Counter(w for i, t in pairs if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    got = attention_lm.score(docs(pairs), out, P.path("byte_bpe_50k.tiktoken"), bpe.PATTERN, top=top, rounds=1).collect()
    assert len(got) == len(pairs)
    for r in got:
        t = next(t for i, t in pairs if i == r["doc_id"])
        w = [*words(t), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r["score"] < 0
    assert attention_lm.score(docs([]), out, P.path("byte_bpe_50k.tiktoken"), bpe.PATTERN, top=top, rounds=1).count() == 0


def test_the_model_learns(docs, spark):
    """On text that repeats a pattern, training beats the first parameters on held-out text."""
    pairs = [(i, "one two three four " * 60) for i in range(150)]
    out = F.pmod(F.col("doc_id"), F.lit(5)) == 0
    score = lambda rounds: attention_lm.score(docs(pairs), out, P.path("byte_bpe_50k.tiktoken"), bpe.PATTERN, rounds=rounds).filter("held_out").agg(F.avg("score")).head()[0]
    assert score(3) > score(0) + 10


# 7 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("v", substrings.COVERS)
def test_covers(v):
    d = substrings.COVERS[v]
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("window", [50, 20, 3])
def test_substrings_against_brute_force(docs, prose, window):
    passages = [prose(75, 900 + s) for s in range(4)]
    pairs = [(i, f"{prose(i % 37, i)} {passages[i % 4]} {prose(i % 23, 500 + i)}") for i in range(10, 60)] + [(90, "a b " * 300), (91, "a b " * 200)] + ODD
    words = {}
    for i, t in pairs:
        if i is not None:
            words[i] = SPACED.findall(t or "")
    least = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][p : p + window]), i)
    for r in substrings.remove_repeats(docs(pairs, parts=5), window).collect():
        i = r["doc_id"]
        if i is None:
            assert r["n_removed"] == 0
            continue
        gone = {q for p in range(len(words[i]) - window + 1) if least[tuple(words[i][p : p + window])] < i for q in range(p, p + window)}
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(words[i]), len(gone), " ".join(x for q, x in enumerate(words[i]) if q not in gone))
    assert substrings.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_substrings_of_rows_of_one_id(docs, prose, broadcast_rows):
    """Places of one row say nothing of another row of the same id; rows of one id don't remove from each other."""
    a, b, c = (prose(70, s, 5000) for s in (1, 2, 3))
    rows = [(5, f"{a} {b}"), (5, f"{c} {c}"), (5, f"{c} {c}"), (3, b), (9, c), (10, "é " * 20000)]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs(rows), broadcast_rows=broadcast_rows).collect())
    assert got == {(5, 140, 70): 1, (5, 140, 0): 2, (3, 70, 0): 1, (9, 70, 70): 1, (10, 20000, 0): 1}


# 8 ------------------------------------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, docs, prose):
    items = [(i, prose(20 + i, 70 + i)) for i in range(6)] + [(10, "Short Item, three"), (11, ""), (12, None), (None, "never"), (13, "one"), (10, "Short Item, three")]
    pairs = [(100 + i, f"{prose(9 * i, i)} {(items[i][1] or '').upper()} {prose(40, i)}") for i in range(6)] + [(200, "a short-item THREE b"), (201, prose(200) + " one")] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    known = defaultdict(set)
    for i, t in items:
        w = split(t)
        for p in range(len(w) - min(13, len(w)) + 1 if w and i is not None else 0):
            known[tuple(w[p : p + 13])].add(str(i))
    seen = False
    for r in decontaminate.report(docs(pairs), bench).collect():
        w = split(next(t for i, t in pairs if i == r["doc_id"]))
        at = [(p, k, known[tuple(w[p : p + k])]) for k in {len(x) for x in known} for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in known]
        hit, found = {q for p, k, _ in at for q in range(p, p + k)}, sorted(set().union(*(f for *_, f in at)))
        seen |= bool(found)
        assert tuple(r)[1:] == (len(w), len(hit), len(found), sha(",".join(found)), bool(hit) and 20 * len(hit) >= len(w))
    assert seen
    kept = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs(pairs), bench).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in decontaminate.clean(docs(pairs), bench).filter("text is not null").collect())
    assert 200 not in kept and kept[201] == prose(200) + " " and kept[3] == " \t\n\r "
    assert decontaminate.report(docs(pairs), bench.limit(0)).filter("n_hit > 0").count() == 0


# 9 ------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 400
    data = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", big + "!"), (8, "u", "\r\n\r\n" * 900), (None, "u", big), (9, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, record_type string").repartition(3)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(pages).collect()}
    for i, _, html in data:
        b = (html or "").encode()
        expected = (len(b), hashlib.sha1(b).hexdigest(), "revisit", 2) if i == 1 else (len(b), hashlib.sha1(b).hexdigest(), "response", None)
        assert got[i] == expected
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_of_a_stream():
    payload = bytes(range(256)) * 40
    head = warc._head(5, "http://x/", hashlib.sha1(payload).hexdigest(), len(payload), None, "2020-01-01T00:00:00Z")
    rows = list(warc.chunks_of(io.BytesIO((head + payload + b"\r\n\r\n") * 2), zipped=False, chunk=1000))
    assert [r["chunk_no"] for r in rows if r["record"] == 1] == list(range(11)) and max(len(r["chunk"]) for r in rows) == 1000
    assert b"".join(r["chunk"] for r in rows if r["record"] == 0) == payload
    assert [r["sha1_so_far"] for r in rows if r["last"]] == [hashlib.sha1(payload).hexdigest()] * 2
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(head + payload[:50]), zipped=False))


# 10 -----------------------------------------------------------------------------------------------------


def test_shards(docs, prose):
    pairs = [(10_000 + i, prose(5, i)) for i in range(300)] + [(1000 + i, prose(6, 5000 + i % 12)) for i in range(60)] + [(5000 + i, "the same") for i in range(200)] + ODD
    got = shards.assign(docs(pairs), 8, bucket_rows=10).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(pairs) and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        t = next((t or "").encode() for i, t in pairs if i == r["doc_id"])
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(list)
    for r in got:
        if 1000 <= (r["doc_id"] or 0) < 2000:
            groups[(r["doc_id"] - 1000) % 12].append(r["shard"])
    assert sum(len(set(g)) == 1 for g in groups.values()) >= 10  # small groups end up together
    hot = Counter(r["shard"] for r in got if 5000 <= (r["doc_id"] or 0) < 6000)
    assert sorted(hot.values())[-3:] and sum(sorted(hot.values())[-4:]) >= 150  # the large one fills whole shards
    assert shards.assign(docs([])).count() == 0


def test_shards_of_a_group_of_a_third_and_of_copies_only(docs):
    """24 shards: a group that needs eight of them, and pairs that fill all the rest, so that room comes from rows that leave."""
    pairs = [(i, "the same") for i in range(800)] + [(1000 + i, f"pair {i % 800}") for i in range(1600)]
    got = shards.assign(docs(pairs), 24, bucket_rows=50).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 2400 and set(sizes.values()) == {100}
    hot = Counter(r["shard"] for r in got if r["doc_id"] < 1000)
    assert sum(sorted(hot.values())[-8:]) > 0.8 * 800
    both = defaultdict(set)
    for r in got:
        if r["doc_id"] >= 1000:
            both[(r["doc_id"] - 1000) % 800].add(r["shard"])
    assert sum(len(b) == 1 for b in both.values()) > 0.5 * 800


@pytest.mark.parametrize("sent_pairs", [0, 1 << 20])
def test_words_of_held_out_texts_come_along_and_count_nothing(docs, spark, sent_pairs):
    """One row a word and none a node: words met in held-out texts alone have a count of 0 and are spelled by the others'
    tree, however small the pieces are that it is taken in."""
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    sub, sent = attention_lm.Subwords(data, attention_lm.PATTERN), spark.sparkContext.broadcast((data, attention_lm.PATTERN))
    texts = docs([(1, "bleores bleore thattish"), (2, "thattishly bleor thatthat bleores"), (3, "Bleores blewhorly thattish"), (4, None), (5, "x" * 40)])
    rows = texts.select("doc_id", F.col("doc_id").isin(2, 5).alias("held_out"), "text").repartition(3, "doc_id").mapInArrow(attention_lm._gather(sent, 4, 3, 100, 1, paths=True), "kind int, word string, n long, ids binary, path binary").cache()
    assert rows.filter(F.col("kind") == attention_lm.TEXTS).agg(F.sum("n")).head()[0] == 3
    counts = {"bleores": 2, "bleore": 1, "thattish": 2, "blewhorly": 1}
    asked = [*counts, "thattishly", "bleor", "thatthat", "x" * 40]
    got, tokens = attention_lm.learn_words(rows.filter(F.col("kind") == attention_lm.WORD).select("word", "n", "path"), sent, sub.size, 1, sent_pairs)
    ids, first = sub.spell(list(counts))
    assert (tokens == np.bincount(ids, np.repeat(list(counts.values()), np.diff(first)), sub.size)).all()
    table = got.every().collect()
    assert {r["word"]: r["n"] for r in table} == {w: counts.get(w, 0) for w in asked} and len(table) == len(asked)
    ids, first = sub.spell(asked)
    direct, back, stop = attention_lm.Lexicon.of_words(list(counts), np.array(list(counts.values())), sub).walk(ids, first)
    found = {r["word"]: r for r in table}
    for i, w in enumerate(asked):
        assert np.allclose(found[w]["direct"], direct[first[i] : first[i + 1]]) and np.allclose(found[w]["back"], back[first[i] : first[i + 1]])
        assert found[w]["stop"] == pytest.approx(stop[i])
