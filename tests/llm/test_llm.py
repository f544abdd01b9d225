"""Each operator beside a brute-force version, and on awkward tables."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from evalweave.llm import (
    bpe,
    components,
    decontamination,
    edit,
    extraction,
    lines,
    lm,
    oracles,
    pii,
    quality,
    queries,
    simhash,
    toxicity,
    warc,
)
from workload import check

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, line int, fp long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    """``n`` words in sentences, another order for each seed."""
    state, out = seed * 7919 + 17, []
    for i in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        word = WORDS[(state >> 8) % len(WORDS)] + WORDS[(state >> 16) % len(WORDS)]
        out.append(word + ("." if i % 9 == 8 else ""))
    return " ".join(out) + "."


LONG = prose(1, 400)
TEXTS = [
    (1, LONG + "\n" + prose(2, 60)),
    (2, LONG + "\n" + prose(3, 60)),
    (3, LONG.replace("alpha", "omega", 1) + "\n" + prose(4, 60)),
    (4, LONG + "\n" + prose(2, 60)),
    (4, LONG + "\n" + prose(2, 60)),
    (5, ""),
    (6, None),
    (7, "one two"),
    (8, "One\tTWO"),
    (9, "  \n\n \t"),
    (10, "x" * 50_000),
    (11, (prose(5, 12) + "\n") * 300),
    (None, prose(6, 70)),
    (None, None),
    (12, "tab\x0bfeed\x0c nbsp here   é ÀÉ 東京 🙂 don't 12345 \r\n" + prose(7, 80)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", len(t or ""), "r", 1, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(nodes, linked):
    """Smallest reachable node of each, by trying all pairs."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if root[a] < root[b] and linked(a, b):
                    root[b], changed = root[a], True
    return root


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (3, 1), (20, 9), (None, 2)] + [(100, 100 + i) for i in range(50)]
    found = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(5, 1), (4, 1), (3, 1), (9, 8), (20, 8)} | {
        (100 + i, 100) for i in range(1, 50)
    }
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for a, b in [("", ""), ("", "ab"), ("kitten", "sitting"), ("abc", "abc"), (prose(1, 9), prose(2, 9)), ("aXb", "ab")]:
        assert edit.distance(a, b) == plain(a, b)
    lines_ = [prose(i, 20 + i % 3) for i in range(12)] + [prose(1, 20).replace("alpha", "omega"), prose(1, 20)[7:], "a b", "b a"]
    for a, b in itertools.product(lines_, lines_):
        for percent in (20, 60, 80, 95):
            assert edit.alike(a, b, percent) == (plain(a, b) <= max(len(a), len(b)) * (100 - percent) // 100)
    pattern, text = "gamma delta", "alpha gama dolta beta"
    least = min(plain(pattern, text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
    assert edit.within(edit.letter_masks(pattern), len(pattern), text) == least


def test_simhash(docs, empty):
    def fingerprint(text):
        w = words(small(text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fingerprint(t) for _, t in TEXTS]
    distinct = sorted(set(fps))
    for block_rows in (2, 1000):
        root = groups(distinct, lambda a, b: (a ^ b).bit_count() <= 2)
        least = {}
        for (i, _), f in zip(TEXTS, fps):
            if i is not None:
                least[root[f]] = min(i, least.get(root[f], i))
        want = collections.Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(TEXTS, fps))
        got = simhash.near_duplicates(docs, block_rows=block_rows).collect()
        assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    left = [fps[[t for _, t in TEXTS].index(r.text)] for r in kept.collect()]
    assert sorted(root[f] for f in left) == sorted(set(root.values()))
    assert simhash.deduplicate(empty).count() == 0


def test_simhash_of_one_id_and_of_none(spark):
    """Texts that share an id are told apart, a copy without an id goes, a row written twice stays once."""
    rows = [(1, prose(61, 50)), (1, prose(62, 50)), (1, prose(62, 50)), (2, prose(61, 50)), (None, prose(62, 50))]
    rows += [(None, prose(63, 50)), (None, prose(63, 50)), (None, prose(64, 50))]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([*rows[:2], *rows[6:]], key=repr)


def test_gray_index_finds_all_pairs():
    import numpy as np

    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << random.integers(0, 64, (40, 30)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, (base[:, None] ^ flips).reshape(-1)]))
    ordered = fps[np.argsort(simhash._ranks(fps))]
    index = simhash.GrayIndex(np.full(len(fps), ~np.uint64(0)), ordered)
    who, leaf = index.search(ordered, 2)
    near = np.bitwise_count(ordered[:, None] ^ ordered[None, :]) <= 2
    assert set(zip(who.tolist(), leaf.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_quality(docs, empty):
    def counted(text):
        w = words(text)
        places = collections.defaultdict(list)
        for i in range(len(w) - 2):
            places[tuple(w[i : i + 3])].append(i)
        covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
        seen = [x for x in (text or "").split("\n") if words(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        return len(w), sum(map(len, w)), symbols, len(seen) - len(set(seen)), len(covered)

    got = collections.Counter((r.doc_id, *r[1:6]) for r in quality.digests(docs).collect())
    assert got == collections.Counter((i, *counted(t)) for i, t in TEXTS)
    assert quality.digests(empty).count() == 0
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns
    assert {r.doc_id for r in cleaned.collect()} == {1, 2, 3, 4, None, 12}


def test_quality_rejects_junk(spark):
    rows = [
        (1, prose(9, 90)),
        (2, " | ".join(prose(9, 90).split())),
        (3, " ".join(w.upper() + "!!" for w in prose(9, 90).split())),
        (4, " ".join(w + "$$$" for w in prose(9, 90).split())),
        (5, "spam " * 90),
        (6, prose(9, 20)),
    ]
    got = quality.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect() if r.kept} == {1}


def test_bpe_is_what_the_library_gives(docs, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in TEXTS:
        ids = own.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        raw = (text or "").encode()
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest()))
    got = bpe.digests(docs, path, public_tokenizers.PATTERN).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0
    decoded = bpe.encode(docs, path, public_tokenizers.PATTERN).collect()
    assert collections.Counter((r.doc_id, r.decoded) for r in decoded) == collections.Counter(
        (i, t or "") for i, t in TEXTS
    )


def line_keys(line):
    """The pairs of segments' blocks that a line is looked up by."""
    values, missing = lines.of_normal([line]).blocks(lines.SEGMENTS)
    full = [(i, v) for i, (v, m) in enumerate(zip(values[0].tolist(), missing[0].tolist())) if not m]
    return set(itertools.combinations(full, lines.AGREEING))


def test_normal_forms_all_at_once():
    """Lines normalised together are what each is alone, with the same hashes wherever they stand."""
    texts = [t or "" for _, t in TEXTS] + ["", "\n", " a_b--c \n\n12 3x4\t\n ---\n- -  -\n İß x\n9", "½ ² ٣٤ é\u0301 _ \u2028 z"]
    seen = {}
    for text in [*texts, "\n".join(texts)]:
        want = {i: lines.normalise(x) for i, x in enumerate(text.split("\n")) if x and not x.isspace()}
        numbers, found = lines.normalised(text)
        ends = found.starts + found.sizes
        spelled = ["".join(map(chr, found.letters[a:b])) for a, b in zip(found.starts, ends)]
        assert dict(zip(numbers.tolist(), spelled)) == want
        alone = lines.of_normal(spelled)
        assert (alone.lines() == found.lines()).all() and (alone.lanes()[0] == found.lanes()[0]).all()
        assert all((x == y).all() for x, y in zip(alone.blocks(6), found.blocks(6)))
        for line, hashed in zip(spelled, found.lines().tolist()):
            assert seen.setdefault(line, hashed) == hashed
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines(docs, empty, broadcast, request):
    if not broadcast:
        request.getfixturevalue("salted")
    texts = set(TEXTS)
    occurrences = [
        ((i is None, i or 0, t, k), lines.normalise(x))
        for i, t in texts
        for k, x in enumerate((t or "").split("\n"))
        if x and not x.isspace()
    ]
    distinct = sorted({x for _, x in occurrences})
    keys = {x: line_keys(x) for x in distinct}
    root = groups(distinct, lambda a, b: keys[a] & keys[b] and edit.alike(a, b, 80))
    first = {}
    for place, x in occurrences:
        first[root[x]] = min(place, first.get(root[x], place), key=lambda p: (p[0], p[1], p[3]))
    want = collections.Counter()
    for place, x in occurrences:
        want[place[2]] += first[root[x]] != place
    found = lines.deduplicate(docs).collect()
    assert {r.row.text: r.n_removed for r in found} == {t: want[t] for _, t in texts}


def test_cleaned_lines(docs, empty):
    cleaned = {r.row.doc_id: r for r in lines.deduplicate(docs.filter("doc_id = 2 or doc_id = 1")).collect()}
    assert cleaned[2].cleaned == prose(3, 60) and cleaned[1].n_removed == 0
    assert lines.digests(empty).count() == 0
    assert lines.clean(docs).columns == docs.columns
    assert lines.digests(docs).count() == len(TEXTS)


def test_lines_of_one_id_and_of_none(spark):
    """Rows that share an id are told apart; rows without one lose lines as well."""
    line = prose(31, 20)
    rows = [(1, line + "\n" + prose(32, 20)), (1, prose(33, 20) + "\n" + line), (None, line), (None, prose(34, 20))]
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {r.row.text: r.n_removed for r in found}
    assert sum(removed[t] for _, t in rows[:2]) == 1 and removed[line] == 1 and removed[rows[3][1]] == 0


def test_lines_connected_through_others(spark):
    """A chain in which each line is like the next only, and lines that share a passage and are not alike."""
    words_ = prose(43, 40).split()
    chain = [" ".join(w if k >= 4 * c else w + "q" * 6 for k, w in enumerate(words_)) for c in range(9)]
    shared = [prose(44, 12) + " " + prose(200 + i, 25) for i in range(12)]
    rows = [(i, line) for i, line in enumerate(reversed(chain))] + [(50 + i, line) for i, line in enumerate(shared)]
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    normal = {i: lines.normalise(line) for i, line in rows}
    keys = {i: line_keys(x) for i, x in normal.items()}
    root = groups(sorted(normal), lambda a, b: keys[a] & keys[b] and edit.alike(normal[a], normal[b], 80))
    assert {r.row.doc_id for r in found if not r.n_removed} == set(root.values())
    assert len(set(root.values())) >= 12 and list(root.values()).count(0) > 2


def test_large_groups_of_near_lines(spark):
    """Two large groups of lines that differ in a word or two: one line of each stays."""
    bases = [prose(41, 30).split(), prose(42, 30).split()]
    rows = []
    for i in range(200):
        copy = list(bases[i % 2])
        copy[(i // 2) % 30] = "changed" + chr(97 + i % 26)
        rows.append((i, " ".join(copy)))
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.row.doc_id for r in found if not r.n_removed} == {0, 1}


@pytest.mark.parametrize("tile,hot", [(4, 1000), (4, 8)])
def test_lines_of_keys_dealt_in_tiles(spark, monkeypatch, tile, hot):
    """Lines that share a passage and are not alike, and near lines among them: as in one tile, with few links."""
    monkeypatch.setattr(lines, "TILE", tile)
    monkeypatch.setattr(lines, "HOT", hot)
    passage = prose(44, 14)
    texts = [prose(200 + i // 2, 25).replace("a", "e" if i % 2 else "a", 1) + " " + passage for i in range(24)]
    texts += [passage + " " + prose(300 + i, 3) for i in range(12)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.row.doc_id for r in lines.deduplicate(table).collect() if not r.n_removed}
    normal = {i: lines.normalise(line) for i, line in enumerate(texts)}
    keys = {i: line_keys(x) for i, x in normal.items()}
    root = groups(sorted(normal), lambda a, b: keys[a] & keys[b] and edit.alike(normal[a], normal[b], 80))
    assert found == set(root.values()) and 12 <= len(found) < 24


def test_near_lines_of_a_key_need_few_rows(spark):
    """What comes out where a key is read grows with its lines, not with their pairs."""
    base = prose(41, 30).split()
    rows = [(i, " ".join(w if k != i % 30 else f"changed{chr(97 + i // 30)}" for k, w in enumerate(base))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.occurrences(docs).withColumn("n", F.lit(1)).withColumn("no", F.col("doc_id")).drop("doc_id")
    keys = lines._met(found, lines.SEGMENTS, lines.AGREEING)
    assert keys.count() > 2000
    assert lines.links(found, docs, lines.SEGMENTS, lines.AGREEING, 80).count() < 2 * keys.count()


@pytest.mark.parametrize("count", [30, 600])
def test_distances_of_many_pairs(count):
    """Together or one by one; a budget only ends the work on what is beyond it."""
    draw = random.Random(6)
    sizes = [0, 1, 63, 64, 65, 130]
    pairs = [tuple("".join(draw.choices("abcñ日", k=draw.choice(sizes))) for _ in "ab") for _ in range(count)]
    want = [edit.distance(a, b) for a, b in pairs]
    assert edit.distances([(a, b, 1000) for a, b in pairs]).tolist() == want
    found = edit.distances([(a, b, 40) for a, b in pairs]).tolist()
    assert all(x == y if y <= 40 else x > 40 for x, y in zip(found, want)) and not len(edit.distances([]))


def test_decontamination(docs, empty, spark, monkeypatch):
    item = prose(50, 25)
    changed = item.replace(item[30], "#", 1).replace(item[40:43], "")
    rows = [(1, "Before. " + item.upper() + " after"), (2, "x " + changed + " y"), (3, prose(60, 60)), (4, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, ""), (9, None), (7, prose(51, 30))], "item_id long, text string")

    def brute(text, pattern):
        text, pattern = decontamination.normalise(text or ""), decontamination.normalise(pattern or "")
        if not pattern.strip():
            return None
        row = [0] * (len(text) + 1)
        for i, x in enumerate(pattern, 1):
            row, before = [i], row
            for j, y in enumerate(text, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return min(row) if min(row) <= (len(pattern) - 2) // 10 else None

    want = {
        (i, b.item_id, edits) for i, t in rows for b in bench.collect() if (edits := brute(t, b.text)) is not None
    }
    assert {1, 2} == {i for i, *_ in want}
    for bound in (1 << 20, 200):
        monkeypatch.setattr(decontamination, "ITEM_BYTES", bound)
        assert {tuple(r) for r in decontamination.matches(table, bench).collect()} == want
    assert {r.doc_id for r in decontamination.decontaminate(table, bench).collect()} == {3, 4, 5}
    assert decontamination.matches(empty, bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, bench).columns == docs.columns


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(docs, empty, order):
    texts = [(i, small(t).split() if False else words(small(t))) for i, t in TEXTS]
    counts = [
        collections.Counter(tuple(w[i : i + n]) for _, w in texts for i in range(len(w) - n + 1))
        for n in range(1, order + 1)
    ]
    total = sum(counts[0].values())

    def share(gram):
        if len(gram) == 1:
            return math.log10(counts[0][gram] / total)
        n = counts[len(gram) - 1][gram]
        return math.log10(n / counts[len(gram) - 2][gram[:-1]]) if n >= 2 else math.log10(0.4) + share(gram[1:])

    want = sorted(
        (i or 0, len(w), round(sum(share(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))), 3))
        for i, w in texts
    )
    scored = lm.score(docs, order, chunk_bytes=3000, range_bytes=4000).collect()
    got = sorted((r.doc_id or 0, r.n_words, round(r.score, 3)) for r in scored)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 0.01 for g, w in zip(got, want))
    assert lm.score(empty, order).count() == 0


def test_pii(docs, empty, spark):
    text = "card 4111 1111 1111 1111 or 4111111111111111, call +1 (212) 555-0199, 134.555.0199 x, ssn 123-45-6789, "
    text += "ip 10.20.30.40. iban DE89370400440532013000 on 2020-02-29, 29.02.2020 or 2/29/2020; mail Jo.42@mail.example.org"
    left = "4111111111111112 999.1.1.1 2021-02-29 31.02.2020 000-12-3456 version 1.2.3 1234567"
    rows = [(1, text), (2, left), (3, None), (4, ""), (None, text)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.pseudonymise(table, "key").collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].text == left and by_id[2].n_values == 0
    assert by_id[3].text is None and by_id[4].text == ""
    new = by_id[1].text
    assert by_id[None].text == new and by_id[1].n_values == 11
    assert len(new) - len(text) in range(-12, 13) and "@mail.example.org" in new and "4111" not in new
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\d{4}(?: ?\d{4}){3}", new)]
    assert len(set(cards[:2])) == 1 and pii.luhn_digit(cards[0][:-1]) == int(cards[0][-1])
    restored = pii.pseudonymise(spark.createDataFrame(got), "key", undo=True).collect()
    assert {r.text for r in restored} == {t for _, t in rows}
    assert pii.pseudonymise(empty, "key").count() == 0
    f = pii.Feistel(b"k")
    assert sorted(f.permuted("x", 1000, n) for n in range(1000)) == list(range(1000))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad -->
<div class="ad">Buy this now.</div><%s><h1>Head&amp;line</h1><p><b>First  para\n&eacute;.<br><p>Second <a href=x>link</a> text.
<div class="advert">Advert inside.</div><p>Third one is long enough to be a text of its own.</%s>
<section class="comments"><p>A reader says something long and silly.</p></section>
<aside>Side.</aside><form>Mail <input></form><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"u{i}", PAGE % ("article", "article")) for i in range(30)]
    rows += [(100, "m", PAGE % ("main", "main")), (101, None, None), (None, "e", ""), (102, "t", "<p>cut <b")]
    rows += [(103, "d", PAGE % ('div class="content"', "div"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in extraction.extract(pages, extraction.train(pages)).collect()}
    want = "Head&line\nFirst para é.\nSecond link text.\nThird one is long enough to be a text of its own."
    assert got[0].text == got[100].text == want and got[0].n_chars == len(want)
    assert "reader" not in got[103].text and "Third one" in got[103].text
    assert got[101].text == "" and got[None].text == ""
    nothing = pages.limit(0)
    assert extraction.extract(nothing, extraction.train(nothing)).count() == 0


def test_marginals_are_exact():
    model = extraction.Model({("node", "tag p", 1): 30, ("label", "", 1): 40, ("label", "", 0): 60, ("edge", "1", 1): 20})
    nodes, _ = extraction.parse("<div><p>one. two</p><ul><li>x</li></ul></div><p>y.</p>")
    odds = [math.exp(sum(map(model._weight, extraction.features(n)))) for n in nodes]
    total, on = 0.0, [0.0] * len(nodes)
    for state in range(1 << len(nodes)):
        label = [state >> i & 1 for i in range(len(nodes))]
        if label[0]:
            continue  # the root holds no text and is no content
        weight = 1.0
        for i, node in enumerate(nodes):
            weight *= odds[i] if label[i] else 1
            weight *= model.edges[label[node.parent]][label[i]] if i else 1
        total += weight
        for i in range(len(nodes)):
            on[i] += weight * label[i]
    for got, want in zip(model.marginals(nodes)[1:], on[1:]):
        assert abs(got - want / total) < 1e-9


def test_revisits(spark):
    schema = "record_id long, url string, captured_at long, headers map<string,string>, digest string, slice int"
    page = "http://a.org/x"
    full = [(i, page, i, {"etag": f'"{i % 3}"', "content-type": "t"}, f"d{i}", 0) for i in range(0, 200, 2)]
    full += [(1000, None, 5, {}, "n", 0), (1001, "http://B.org:80/y/?b=2&a=1&utm_source=q#f", 10, None, "same", 0)]
    asked = [(i, "HTTP://A.org/x/#top", i, {"etag": f'W/"{i % 3}"', "date": "now", "content-type": "no"}, None, 0) for i in range(0, 230, 3)]
    asked += [(500, None, 9, {}, None, 0), (501, "http://b.org/y?a=1&b=2", 11, {}, "same", 0), (502, "http://b.org/y?a=1&b=2", None, {}, None, 0)]
    got = warc.resolve(spark.createDataFrame(full, schema), spark.createDataFrame(asked, schema)).collect()
    found = {r.revisit_id: r for r in got}
    assert len(got) == len(asked)
    for i, _, at, headers, _, _ in asked[:-3]:
        earlier = [r for r in full[:-2] if r[2] < at]
        if not earlier:
            assert found[i].status == warc.NO_RESPONSE
            continue
        last = max(earlier, key=lambda r: (r[2], r[0]))
        assert found[i].response_id == last[0]
        if last[3]["etag"] == headers["etag"][2:]:
            assert found[i].headers == {"etag": headers["etag"], "date": "now", "content-type": "t"}
            assert found[i].digest == last[4]
        else:
            assert found[i].status == warc.MISMATCH and found[i].headers is None
    assert found[500].status == found[502].status == warc.NO_RESPONSE
    assert found[501].status == warc.RESOLVED
    none = spark.createDataFrame([], schema)
    assert warc.resolve(none, none).count() == 0


def test_toxicity_learns(spark, docs, empty):
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 7 == 0
        rows.append((i, prose(i, 30) + (" you idiot scum" if toxic else " you friend")))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(table, marks).collect()
    held = [r for r in got if r.held_out]
    assert 200 < len(held) < 400 and len(got) == 1500
    assert all(r.predicted == (r.doc_id % 7 == 0) and 0 <= r.score <= 1 for r in held)
    machine = toxicity.fit(table, marks)
    assert toxicity.score(docs, machine).count() == len(TEXTS)
    assert toxicity.toxicity(empty, marks.limit(0)).count() == 0


def test_interactions_are_learnt():
    """Two words that are harmless alone and toxic together."""
    import numpy as np

    random = np.random.default_rng(5)
    rows = [[t for t in (1, 2) if random.random() < 0.5] + [int(x) for x in random.integers(10, 30, 5)] for _ in range(4000)]
    rows = [sorted(set(r)) for r in rows]
    labels = np.array([float(1 in r and 2 in r) for r in rows])
    scores = toxicity.fitted(rows, labels).scores([[1], [2], [1, 2], []])
    assert scores[2] > 0.5 > max(scores[0], scores[1], scores[3])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    rows = [(i, prose(i % 6, 120) + f"\n{prose(40 + i % 6, 30)}", "en", "s", 0) for i in range(12)]
    rows += [(20, "junk", "en", "s", 4), (21, prose(30, 80) + " " + prose(99, 20), "en", "s", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, prose(99, 20))], "item_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(6))
    assert all(r.n_tokens > 0 for r in got)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    got = queries.QUERIES[name](spark, folder)
    assert check.compare(got, check.connect(folder), oracles.ORACLES[name]) is None
