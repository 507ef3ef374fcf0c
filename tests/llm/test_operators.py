"""The ten operators on small hand-made tables: odd cases, ties, nulls, and brute force."""

import hashlib
import io
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlake.llm import decontam, langid, licenses, line_chunks, lm, media, mixing, near_dup, pii, token_shards
from barlake.llm.elias_fano import EliasFano
from barlake.llm.words import alnum_table, row_slices, space_table, text_buffer, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, digest int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def docs(spark, texts, lang=None, source=None):
    rows = [(i, t, lang[i] if lang else "en", source[i] if source else "s", len(t or ""), "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


# --- words ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\n\x0bé漢.,-\x00", max_size=12)), max_size=6))
def test_words_follow_their_patterns(texts):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    for table, pattern in ((space_table(), "[^\x20\x09-\x0d]+"), (alnum_table(), "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        w = words_of(data, offsets, table)
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        want = [re.findall(pattern, t) for t in low]
        assert np.diff(w.offsets).tolist() == [len(x) for x in want]
        flat = [x for row in want for x in row]
        for i in range(len(flat)):
            for j in range(i):
                assert (flat[i] == flat[j]) == (w.hashes[i] == w.hashes[j])
    assert [x for a, b in row_slices(offsets, 3) for x in range(a, b)] == list(range(len(texts)))


# --- 1 PII ---------------------------------------------------------------------------------


def found(text):
    base, added = pii.spans(text)
    return [(text[a:b], k) for a, b, k in base], [(text[a:b], k) for a, b, k in added]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("john [at] example [dot] com", "email", "john [at] example [dot] com"),
        ("user＠example.com", "email", "user＠example.com"),
        ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
        ("pay four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("іvan@exаmple.com", "email", "іvan@exаmple.com"),
    ],
)
def test_disguises_map_back(text, kind, part):
    base, added = found(text)
    assert (part, kind) in added and base == [x for x in base if x not in added]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail john at example.com now", "email", "john at example.com"),
        ("john_at_example.com", "email", "john_at_example.com"),
        ("call +1 415 dash 555 dash 2671", "phone", "+1 415 dash 555 dash 2671"),
        ("pay 4111 hyphen 1111 minus 1111 dash 1111", "card", "4111 hyphen 1111 minus 1111 dash 1111"),
        ("“four 111 1111 1111 1111", "card", "four 111 1111 1111 1111"),
        ("call +1 fİve 5 5 415 2671", "phone", "+1 fİve 5 5 415 2671"),
    ],
)
def test_one_disguise_is_enough(text, kind, part):
    base, added = found(text)
    assert (part, kind) in added
    # words elsewhere in the text change nothing
    assert found(f"one point of it. {text}") == (base, added)


def test_plain_text_is_left_alone():
    for text in ("", None, "one of the two at the dot", "meet me at four", "a@b", "1.2.3", "é" * 50):
        assert pii.spans(text) == ([], [])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="a1.@+-( )9%é", max_size=40))
def test_base_spans_are_the_patterns(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    want = [(m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if keep[k](m[0])]
    assert sorted(pii.detect(text)) == sorted(want)


def slow_spans(text):
    """Added spans by a list of characters, each with the source characters it came from."""
    chars = [(c, i, i + 1) for i, c in enumerate(text)]

    def rewritten(edits):
        out, at = [], 0
        for a, b, new in edits:
            out += chars[at:a] + [(c, chars[a][1], chars[b - 1][2]) for c in new]
            at = b
        return out + chars[at:]

    odd = pii._odd_characters()
    chars = rewritten([(i, i + 1, odd[c]) for i, (c, _, _) in enumerate(chars) if c in odd])
    chars = rewritten(pii._spelled_edits("".join(c for c, _, _ in chars)))
    signs = []
    for m in pii._SIGN.finditer("".join(c for c, _, _ in chars)):
        word = m["bracketed"] or m["spaced"] or m["plus"]
        signs.append((m.start(), m.end(), pii.SIGNS.get(word.lower(), word)))
    chars = rewritten(signs)
    plain, base = "".join(c for c, _, _ in chars), pii.detect(text)
    if plain == text:
        return []
    found = [(chars[a][1], chars[b - 1][2], k) for a, b, k in pii.detect(plain)]
    # a span that overlaps a plain one of its kind is added only where it grows over it
    return [(a, b, k) for a, b, k in found if all(k != kind or y <= a or b <= x or (a <= x and y <= b and (a, b) != (x, y)) for x, y, kind in base)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["john", " at ", " [at] ", "example", " dot ", ".com", "@", "＠", "one ", "two ", "3", "four ", " dash ", "plus ", "+1", "\u200b", "е", "192", ".", " (dot) ", "1111 ", " punkt ", "x", "\n"]), max_size=14).map("".join))
def test_added_spans_are_brute_force(text):
    assert pii.spans(text)[1] == slow_spans(text)


def test_numbers_of_any_length():
    assert pii.detect("1.2.3." + "0" * 5000 + "4")[0][2] == "ip" and not [x for x in pii.detect("1.2.3." + "4" * 5000) if x[2] == "ip"]


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "+" * 300_000, "1." * 100_000, "@" * 100_000):
        pii.spans(text)


def test_pii_rows(spark):
    got = by_id(pii.identifiers(docs(spark, ["x@y.co 1.2.3.4", None, "", "x@y.co 1.2.3.4"])))
    assert got[0].base == got[3].base and len(got[0].base) == 2 and got[1].base == [] == got[2].added
    assert pii.identifiers(docs(spark, ["a"]).where("false")).count() == 0


# --- 2 line chunks ---------------------------------------------------------------------------


def test_repeated_passages_go(spark):
    passage = "\n".join(f"shared line number {i} of the passage" for i in range(40))
    own = ["\n".join(f"{w} own {i}" for i in range(6)) for w in ("a", "b", "c")]
    texts = [f"{own[0]}\n{passage}\nend a", f"{own[1]}\n{passage}\nend b", own[2], None, "", "one line", "one line", f"{own[0]}\n{passage}\nend a"]
    got = by_id(line_chunks.drop_repeated_chunks(docs(spark, texts)))
    assert got[0].text == texts[0] and got[0].n_removed == 0
    assert got[1].n_removed > 0 and "b own 0" in got[1].text and len(got[1].text) < len(texts[1]) and got[1].text.endswith("end b")
    assert got[2].text == texts[2] and got[3].text is None and got[4].text == "" and got[5].text == got[6].text == "one line"
    assert got[7].n_removed_lines >= 45
    assert line_chunks.drop_repeated_chunks(docs(spark, ["a"]).where("false")).count() == 0


def test_short_passages_go_whole(spark):
    own = [[f"own line {j} of text {i}" for j in range(8)] for i in range(60)]
    passages = [[f"line {j} of passage {p} that both have" for j in range(2 + p % 4)] for p in range(20)]
    at = [(7 * i + p) % 9 for i in range(3) for p in range(20)]
    texts = ["\n".join([*own[i][: at[i]], *passages[i % 20], *own[i][at[i] :]]) for i in range(60)]
    got = by_id(line_chunks.drop_repeated_chunks(docs(spark, [*texts, texts[0], "long and alone " * 99, "long and alone " * 99, "x\nx\nx", "y\ny\ny\ny\ny"])))
    assert all(got[i].text == texts[i] and got[i].n_removed_lines == 0 for i in range(20))
    for i in range(20, 60):
        assert got[i].text == "\n".join(own[i]) and got[i].n_removed_lines == len(passages[i % 20])
    # a whole copy leaves nothing, a single line and a pair on its own first place stay
    assert [got[i].text for i in range(60, 65)] == ["", "long and alone " * 99, "long and alone " * 99, "x\nx\nx", "y\ny"]


def test_blank_lines_and_equal_rows(spark):
    lines = [f"line {i} of the passage" for i in range(9)]
    spaced, dense = "\n\n".join(lines), "\n".join(lines)
    # the first place has other blank lines than the later copies
    rows = [(0, spaced), (1, dense), (2, dense), (3, dense), (None, dense), (None, dense)]
    rows += [(7, "a\nb\nc")] * 3 + [(7, "d\ne")] * 2 + [(7, "own\nlines"), (7, None), (7, None), (8, "alone"), (8, "alone")]
    out = line_chunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r.doc_id, r.text) for r in out)
    assert got == Counter([(0, spaced), (1, dense), (2, ""), (3, ""), (None, dense), (None, dense), (7, "a\nb\nc"), (7, ""), (7, ""), (7, "d\ne"), (7, ""), (7, "own\nlines"), (7, None), (7, None), (8, "alone"), (8, "alone")])


def test_chunks_cover_every_byte():
    text = "\n\nfirst\nsecond\n\nthird\n" * 9
    data, offsets = text_buffer(pa.array([text, "", "x", text]))
    for row, parts in line_chunks.chunks(data, offsets):
        size = int(offsets[row + 1] - offsets[row])
        start = int(offsets[row])
        assert parts[0][0] == start and parts[-1][1] == start + size and all(a[1] == b[0] for a, b in zip(parts[:-1], parts[1:], strict=True))


# --- 3 mixing --------------------------------------------------------------------------------


def water(sizes):
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, live = {}, float(sum(sizes.values())), list(names)
    while live:
        level = left / sum(weight[s] for s in live)
        over = [s for s in live if level * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in live}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            live.remove(s)
    return target


def test_mixing(spark):
    rng = np.random.default_rng(1)
    source = [("b", "a", None, "c", "empty")[i % 5] if i % 4 else "b" for i in range(400)]
    texts = [None if s == "empty" else " ".join(["w"] * int(rng.integers(0, 30 if s == "a" else 90))) for s in source]
    df = docs(spark, texts, source=source)
    got = mixing.mixed(df).collect()
    sizes = Counter()
    for r in got:
        sizes[source[r.doc_id]] += r.size
        assert r.size == len((texts[r.doc_id] or "").split()) and r.taken <= 3 * r.size
    want, taken = water(sizes), Counter()
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 45 for s in sizes)
    again = mixing.mixed(df.repartition(7))
    assert sorted(again.collect()) == sorted(got)
    assert mixing.mixed(df.where("false")).count() == 0


# --- 4 licenses ------------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    damaged = mit.split()
    damaged[3::25] = ["changed"] * len(damaged[3::25])
    texts = [f"{prose(1, 300)} {mit} {prose(2, 300)}", " ".join([prose(3, 40), *damaged]), "Licensed under the Apache License, Version 2.0.", "ALL RIGHTS  RESERVED", prose(4, 2000), None, "", mit]
    got = {i: {m.template_id for m in r.matches} for i, r in by_id(licenses.license_matches(docs(spark, texts))).items()}
    assert got == {0: {"mit"}, 1: set() if len(damaged[3::25]) > 6 else {"mit"}, 2: {"apache-2.0-line"}, 3: {"all-rights-reserved"}, 4: set(), 5: set(), 6: set(), 7: {"mit"}}
    own = licenses.license_matches(docs(spark, ["x a b c d e f g y"]), [("t", "a b c d e f g"), ("none", None), ("blank", " ")]).first()
    assert [(m.template_id, m.start, m.end, m.containment) for m in own.matches] == [("t", 1, 8, 1.0)]


def test_license_windows_against_brute_force():
    """Every window's containment, by sets of words: nothing is missed and nothing invented."""
    rng = np.random.default_rng(5)
    bodies = {n: [f"t{n}w{i % (n * 9 // 10 + 1)}" for i in range(n)] for n in (3, 5, 9, 17, 40, 90, 200, 500)}
    index = licenses.Templates([(str(n), " ".join(x)) for n, x in bodies.items()])
    sets = {str(n): {tuple(x[i : i + min(5, n)]) for i in range(n - min(5, n) + 1)} for n, x in bodies.items()}
    for _ in range(60):
        words = []
        for n in rng.choice(list(bodies), 3):
            body = [w if rng.random() > rng.choice([0, 0.02, 0.06, 0.2]) else "other" for w in bodies[int(n)]]
            words += [*prose(int(rng.integers(1, 999)), int(rng.integers(1, 200))).split(), *body]
        data, offsets = text_buffer(pa.array([" ".join(words)]))
        w = words_of(data, offsets, alnum_table())
        found = index.matches(w.hashes, w.offsets)[0]
        for t, start, end, share in found:
            own = sets[index.names[t]]
            k = len(next(iter(own)))
            held = {tuple(words[i : i + k]) for i in range(start, end - k + 1)} & own
            assert len(held) / len(own) == pytest.approx(share) and share >= 0.75
        for name, own in sets.items():
            n, k = int(name), len(next(iter(own)))
            size = max(4, 1 << (n - 5).bit_length()) if n >= 5 else 1
            block = max(1, size // 4)
            grams_ = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            windows = range(0, len(grams_), block) if n >= 5 else range(len(grams_))
            want = any(len(own & set(grams_[x : x + (5 * block if n >= 5 else 1)])) >= 0.75 * len(own) for x in windows)
            assert want == any(index.names[t] == name for t, *_ in found)


def test_repeated_notices_stay_linear():
    index = licenses.Templates(list(licenses.TEMPLATES.items()))
    # windows are longer than a template, so that two copies side by side may count as one match
    for name, times, least in (("all-rights-reserved", 50_000, 50_000), ("mit-line", 10_000, 10_000), ("mit", 1_500, 700)):
        data, offsets = text_buffer(pa.array([f"{licenses.TEMPLATES[name]} x. " * times]))
        w = words_of(data, offsets, alnum_table())
        assert sum(index.names[m[0]] == name for m in index.matches(w.hashes, w.offsets)[0]) >= least


# --- 5 decontamination -----------------------------------------------------------------------


def brute_hits(texts, items, n=13):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = {}
    for key, text in items:
        x = cut(text)
        m = min(n, len(x))
        for i in range(len(x) - m + 1 if x else 0):
            windows.setdefault(tuple(x[i : i + m]), set()).add(key)
    out = []
    for t in texts:
        x, hit, named = cut(t), set(), set()
        for m in {len(w) for w in windows}:
            for i in range(len(x) - m + 1):
                if (found := windows.get(tuple(x[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    named |= found
        out.append((len(x), len(hit), sorted(map(str, named - {None}))))
    return out


@pytest.mark.parametrize("block_words", [4_000_000, 60])
def test_decontamination_is_brute_force(spark, block_words):
    items = [(i, prose(i, 14 + i)) for i in range(8)] + [(20, "tiny item here"), (21, None), (22, "  "), (None, "another tiny item text"), (1, prose(1, 15))]
    items += [(30, "a " * 200), (31, "b c " * 60), (32, "a " * 200), (32, "a " * 200)]
    body = prose(3, 17)
    texts = ["a " * 3000, "x " + "b c " * 900, "a " * 12 + "c b " * 7, prose(1, 15), prose(3, 20_000)]
    texts += [f"{prose(50, 40)} {body} {prose(51, 9)} tiny item here {body}", body, " ".join(body.split()[:12]), "tiny ITEM, here!", None, "", prose(60, 500), "another tiny item text", body.upper(), f"{body} {body} {body}"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontam.contaminated_spans(docs(spark, texts), bench, block_words=block_words))
    want = brute_hits(texts, items)
    assert [(r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for _, r in sorted(got.items())] == want
    verdict = by_id(decontam.decontaminate(docs(spark, texts), bench))
    assert [verdict[i].contaminated for i in range(len(texts))] == [h > 0 and 20 * h >= n for n, h, _ in want]
    assert decontam.contaminated_spans(docs(spark, texts), bench.where("false")).where("size(spans) > 0").count() == 0
    assert decontam.decontaminate(docs(spark, texts).where("false"), bench).count() == 0
    table = spark.createDataFrame([(None if i % 3 else i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id long, spans string")
    left = [i for i, (n, h, _) in enumerate(want) if not (h > 0 and 20 * h >= n)]
    assert sorted(r.item_id for r in decontam.uncontaminated(table, bench).collect()) == left


def test_repeated_words_stay_linear():
    index = decontam.Index.of([1], pa.array(["a " * 200]), 13, 6)
    data, offsets = text_buffer(pa.array(["a " * 500_000]))
    w = words_of(data, offsets, alnum_table())
    start, _, _, item = index.hits(w, np.zeros(500_000, np.int64), 13, 6)
    assert len(start) == 500_000 - 12 and item.tolist() == [0]


# --- 6 near duplicates -----------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(text, seed, n):
    rng, words = np.random.default_rng(seed), text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def test_near_duplicates_are_brute_force(spark):
    base = [prose(i, 150) for i in range(3)]
    texts = [edited(base[i % 3], i, i % 9) for i in range(60)] + [base[0]] * 4 + ["a b", "A  B", "a c", None, "", " ", prose(99, 80)]
    want, sizes = brute_components(texts)
    got = by_id(near_dup.near_duplicates(docs(spark, texts)))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert near_dup.near_duplicates(docs(spark, texts).where("false")).count() == 0


def test_near_duplicate_rows_and_ids(spark):
    base = prose(5, 60)
    near, other = edited(base, 7, 1), prose(6, 60)
    # id 5 stands on two texts, one of them near id 1; equal rows; rows without id; very long texts
    long = prose(8, 40_000)
    rows = [(1, base), (5, near), (5, other), (9, other), (9, other), (None, base), (None, prose(77, 30)), (None, prose(77, 30)), (7, ""), (7, ""), (11, long), (12, edited(long, 3, 50)), (None, None)]
    table = spark.createDataFrame([(i, t, 0, 1, "x") for i, t in rows], "doc_id long, text string, node long, band int, component_id string").repartition(3)
    out = near_dup.near_duplicates(table).collect()
    want = Counter([(1, 1, True), (5, 1, False), (5, 5, True), (9, 5, False), (9, 5, False), (None, 1, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (11, 11, True), (12, 11, False), (None, None, True)])
    assert Counter((r.doc_id, r.component_id, r.kept) for r in out) == want
    kept = near_dup.one_of_each(table)
    assert kept.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, base), (5, other), (None, prose(77, 30)), (7, ""), (7, ""), (11, long), (None, None)])
    assert near_dup.one_of_each(table.where("false")).count() == 0


def test_remaining_links_in_stripes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(near_dup, "STRIPE", 2)
    monkeypatch.setattr(near_dup, "ROUNDS", 1)
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", 0)
    base = prose(1, 150)
    texts = [edited(base, i, 2 + i % 7) for i in range(70)]
    got = by_id(near_dup.near_duplicates(docs(spark, texts)))
    assert [got[i].component_id for i in range(70)] == brute_components(texts)[0]


def test_likelihood_tells_similar_from_not():
    rng = np.random.default_rng(3)
    for share, want in ((0.9, True), (0.78, True), (0.3, False)):
        n = 400
        both = int(2 * n * share / (1 + share))
        x, y, z = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (both, n - both, n - both))
        a, b = near_dup.registers(np.concatenate((x, y))), near_dup.registers(np.concatenate((x, z)))
        assert (np.maximum(near_dup.registers(x), near_dup.registers(y)) == a).all()  # mergeable
        up, same = np.array([(a > b).sum()]), np.array([(a == b).sum()])
        assert near_dup.rising(up, near_dup.REGISTERS - up - same, same, np.array([float(n)]), np.array([float(n)]))[0] == want


# --- 7 language model ------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 2), min_size=1, max_size=80))
def test_elias_fano(values):
    v = np.sort(np.array(values, np.uint64))
    e, _ = EliasFano.read(np.concatenate(EliasFano.of(v).words()), 0)
    assert (e.access(np.arange(len(v))) == v).all()
    q = np.concatenate((v, v + np.uint64(1), np.array([0], np.uint64)))
    at = np.searchsorted(v, q)
    assert (e.find(q) == at).all()
    assert (e.index(q) == np.where(np.append(v, 0)[at] == q, np.where(at < len(v), at, -1), -1)).all()


def test_language_model(spark):
    texts = [prose(i % 7, 30) for i in range(40)] + [None, "", "unseen words only", "alpha alpha alpha"]
    df = docs(spark, texts)
    model = lm.fit(df.where("doc_id < 30"))
    got = by_id(lm.scores(df, model))
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    one, two = Counter(x for t in tokens[:30] for x in t), Counter((h, w) for t in tokens[:30] for h, w in zip([None, *t[:-1]], t, strict=True))
    three = Counter(x for t in tokens[:30] for x in zip([None, *t], t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)
    for i, t in enumerate(tokens):
        p1 = [(one[w] + 1) / (n + v + 1) for w in t]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(one[w] > 0 for w in t), n)
        assert got[i].base_score == pytest.approx(sum(np.log10(p1)), abs=1e-9)
        p2 = [(two[h, w] + lm.MU * p) / (one[h] + lm.MU) for h, w, p in zip([None, *t[:-1]], t, p1, strict=True)]
        p3 = [(three[g, h, w] + lm.MU_3 * p) / (two[g, h] + lm.MU_3) for g, h, w, p in zip([None, *t], t, t[1:], p2[1:], strict=False)]
        assert got[i].score == pytest.approx(sum(np.log10([p2[0], *p3])), abs=0.01 * len(t))
    known = list(one)
    total = sum((two[None, w] + lm.MU * (one[w] + 1) / (n + v + 1)) / (one[None] + lm.MU) for w in known) + lm.MU / (n + v + 1) / (one[None] + lm.MU)
    assert total == pytest.approx(1)


def test_language_model_over_many_shards(spark, monkeypatch):
    """Contexts cut into several shards: small shards give the scores of one shard."""
    rows = ["the " + " the ".join(prose(i % 11, 60).split()) for i in range(60)] + ["the the the " * 40, "a the b"]
    df = docs(spark, rows)
    whole = by_id(lm.scores(df, lm.fit(df.where("doc_id < 50"))))
    monkeypatch.setattr(lm, "SHARD_1", 200)
    monkeypatch.setattr(lm, "SHARD_2", 300)
    model = lm.fit(df.where("doc_id < 50"))
    cut = by_id(lm.scores(df, model))
    assert len(model.there) > 50 and (model.pairs.heads > 0).any()  # a context's successors do lie in several
    for i, row in whole.items():
        assert cut[i].n_known == row.n_known and cut[i].base_score == pytest.approx(row.base_score)
        assert cut[i].score == pytest.approx(row.score, abs=0.01 * row.n_tokens)


def test_language_model_without_training(spark):
    df = docs(spark, ["a b", None])
    got = by_id(lm.scores(df, lm.fit(df.where("false"))))
    assert got[0].n_known == 0 == got[0].train_tokens and got[0].base_score == 0 == got[1].score


# --- 8 media ---------------------------------------------------------------------------------


@given(st.binary(max_size=300))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(content):
    stored = media.encode(content)
    payload = media.decode(stored)
    assert payload[: len(content)] == content and len(payload) % 64 == 0 and len(payload) > 0 and not payload[len(content) :].strip(b"\0")
    assert media.header(stored[: media.HEADER_BYTES]) == (64, len(payload) // 64, 8)


def test_media_columns(spark):
    texts = ["héllo", "", None, "héllo", "x" * 64, "x" * 65]
    got = by_id(media.media_columns(docs(spark, texts).repartition(3)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[0].media_sha256 == got[3].media_sha256 and got[0].media_offset == got[3].media_offset and got[1].digest == got[2].digest
    fs, path = pa.fs.FileSystem.from_uri(got[0].media_uri)
    with fs.open_input_stream(path) as f:
        shard = tarfile.open(fileobj=io.BytesIO(f.read()))
    assert hashlib.sha256(shard.extractfile(f"{got[0].digest}.png").read()).hexdigest() == got[0].media_sha256
    assert media.media_columns(docs(spark, texts).where("false")).count() == 0


def test_media_shards_are_cut_and_headers_suffice(spark, monkeypatch, tmp_path):
    texts = [prose(i, 40 + i) for i in range(30)] + [prose(1, 41)] * 3 + [prose(3, 30_000)]
    rows = [(i % 31, t, b"x", 5) for i, t in enumerate(texts)] + [(None, "x", None, None), (None, "x", None, None), (4, texts[4], None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest binary, id int").repartition(2)
    monkeypatch.setattr(media, "SHARD_BYTES", 4096)
    out = media.media_columns(table).collect()
    assert len(out) == len(rows) and len({r.media_uri for r in out}) > 4
    for r in out:
        assert r.payload_sha256 == hashlib.sha256((lambda x: x + bytes(-len(x) % 64))(next(t for t in [*texts, "x"] if hashlib.sha256(t.encode()).hexdigest() == r.digest).encode())).hexdigest()
    # shards that hold nothing but the headers' bytes give the same metadata
    for uri in {r.media_uri for r in out}:
        size = pa.fs.FileSystem.from_uri(uri)[0].get_file_info(pa.fs.FileSystem.from_uri(uri)[1]).size
        bare = np.zeros(size, np.uint8)
        whole = np.fromfile(uri.removeprefix("file://"), np.uint8)
        for r in out:
            if r.media_uri == uri:
                bare[r.media_offset : r.media_offset + 33] = whole[r.media_offset : r.media_offset + 33]
        bare.tofile(f"{tmp_path}/{uri.rpartition('/')[2]}")
    moved = spark.createDataFrame([(f"file://{tmp_path}/{r.media_uri.rpartition('/')[2]}", r.media_offset, r.height) for r in out], "media_uri string, media_offset long, want int")
    got = media.header_columns(moved.select("media_uri", "media_offset")).join(moved.distinct(), ["media_uri", "media_offset"]).collect()
    assert len(got) == len(out) and all((r.width, r.height, r.bit_depth) == (64, r.want, 8) for r in got)


# --- 9 language ------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = langid.fit(df.where("doc_id % 5 <> 0"))
    got = langid.identify(df.where("doc_id % 5 = 0"), filters).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_texts(spark):
    texts = ["the quick brown fox " * 5, "der schnelle braune fuchs " * 5, None, "", "123 !!", "q", "the quick brown fox"]
    labels = ["en", "de", "en", None, "de", None, None]
    df = docs(spark, texts, lang=labels)
    got = by_id(langid.identify(df, langid.fit(df.union(df))))
    assert [got[i].lang_pred for i in range(7)][:2] == ["en", "de"] and [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3
    assert got[5].score == 0 and got[5].lang_pred in ("en", "de") and got[6].lang_pred == "en"
    none = langid.identify(df, langid.fit(df.where("false")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_is_brute_force(spark, sf_dir):
    """Sets of n-grams in place of filters: the same decisions but for the filters' false positives."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and length(text) < 4000").select("doc_id", "text", "lang")
    rows = df.collect()

    def grams_of(text):
        line = re.sub(" +", " ", " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text))
        return [line[i : i + langid.N] for i in range(len(line) - langid.N + 1)]

    seen, sizes = {}, Counter(r.lang for r in rows)
    for r in rows:
        for g in set(grams_of(r.text)):
            seen.setdefault(g, Counter())[r.lang] += 1
    known = {x: set() for x in sizes}
    for g, counts in seen.items():
        shares = {x: n / sizes[x] for x, n in counts.items() if n >= 2 and n / sizes[x] >= langid.MIN_SHARE}
        for x, share in shares.items():
            if share >= langid.MIN_RATIO * max(shares.values()):
                known[x].add(g)
    got = by_id(langid.identify(df, langid.fit(df)))
    for r in rows:
        own = grams_of(r.text)
        want = {x: sum(g in known[x] for g in own) / max(1, len(own)) for x in sorted(sizes)}
        best = max(want, key=want.get)
        assert got[r.doc_id].score == pytest.approx(want[got[r.doc_id].lang_pred], abs=0.02)
        assert got[r.doc_id].lang_pred == best or want[best] - want[got[r.doc_id].lang_pred] < 0.02


# --- 10 tokens -------------------------------------------------------------------------------

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_bijection(n):
    slots = token_shards.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert (token_shards.feistel(slots, n, inverse=True) == np.arange(n)).all()
    assert n < 10 or (slots != np.arange(n)).any()


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sreldlvé1２!? \x1c漢", max_size=25), min_size=1, max_size=5))
def test_pieces_are_the_tokenizers_own(texts):
    encoder = token_shards._encoder(TOKENIZER, token_shards.Tokenizer.PATTERN)
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    ids, bounds = token_shards.Tokenizer(TOKENIZER).rows(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [encoder.encode_ordinary(t) for t in texts]


def test_a_full_piece_table_forgets(monkeypatch):
    monkeypatch.setattr(token_shards, "PIECES", 40)
    encoder = token_shards._encoder(TOKENIZER, token_shards.Tokenizer.PATTERN)
    tokenizer = token_shards.Tokenizer(TOKENIZER)
    for seed in range(6):
        text = f"{prose(seed, 60)} own{seed}piece {seed}"
        data, offsets = text_buffer(pa.array([text, text[:30]]))
        ids, bounds = tokenizer.rows(data, offsets)
        assert ids[: bounds[1]].tolist() == encoder.encode_ordinary(text) and ids[bounds[1] :].tolist() == encoder.encode_ordinary(text[:30])


def test_shards_hold_every_token_once(spark, tmp_path):
    texts = [prose(i, 20 + i) for i in range(30)] + [None, "", "x", prose(5, 900), "x", "x"]
    rows = [(i if i < 34 else None if i == 34 else 3, t, 1, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, part string")
    df.repartition(3).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    parts = [[(r.doc_id, r.text) for r in part] for part in df.rdd.glom().collect()]
    out = token_shards.materialise(df, TOKENIZER, length=16, per_shard=7, waves=2).orderBy("slot").collect()
    assert [r.slot for r in out] == list(range(len(out)))
    # brute force: pack every partition, then put each sequence at its slot
    encoder = token_shards._encoder(TOKENIZER, token_shards.Tokenizer.PATTERN)
    packed = []
    for part in parts:
        flat = [(i, doc) for doc, t in part for i in [*encoder.encode_ordinary(t or ""), 50256]]
        packed += [flat[a : a + 16] for a in range(0, len(flat), 16)]
    slots = token_shards.feistel(np.arange(len(packed)), len(packed)).tolist()
    want = [packed[i] for i in np.argsort(slots)]
    raws = []
    for r, seq in zip(out, want, strict=True):
        fs, path = pa.fs.FileSystem.from_uri(r.uri)
        with fs.open_input_file(path) as f:
            raws.append(f.read_at(32, r.byte_offset))
        assert (r.shard, r.byte_offset, r.crc32) == (r.slot // 7, r.slot % 7 * 32, zlib.crc32(raws[-1]))
        ids = np.frombuffer(raws[-1], np.uint16).tolist()
        assert ids == [i for i, _ in seq] + [50256] * (16 - len(seq)) and r.n_ids == len(seq)
        assert set(r.doc_ids) == {d for _, d in seq}
    folder = out[0].uri.rpartition("/")[0]
    for slot in (0, 6, 7, 8, len(out) - 1, len(out)):
        assert [x.tobytes() for x in token_shards.read_from(folder, slot)] == raws[slot:]
    assert token_shards.materialise(df.where("false"), TOKENIZER).count() == 0


# --- odd tables, all operators ------------------------------------------------------------------


def test_odd_rows_everywhere(spark):
    """Nulls, empty and very long texts, equal rows, ties and clashing names: every row comes out, equal ones alike."""
    long = " ".join(prose(i, 500) + "\n" + prose(i + 1, 500) for i in range(60))
    rows = [(1, "alpha beta\ngamma delta"), (1, "alpha beta\ngamma delta"), (1, "other text\nhere now"), (None, "alpha beta\ngamma delta"), (None, None), (2, None), (3, ""), (3, ""), (4, long), (5, long), (6, " \n\n "), (7, "x"), (1, "alpha beta\ngamma delta")]  # the last is equal to the first in its source too
    clash = "row_key string, target string, copies string, component_id string, slot string, node string, size string, copy string, spans string, digest string, n_words string, pair string"
    table = spark.createDataFrame([(i, t, "en" if t else None, None if k % 3 else "s", *["c"] * 12) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, lang string, source string, {clash}").repartition(3)
    bench = spark.createDataFrame([(1, prose(0, 20)), (None, None)], "item_id long, text string")
    operators = {
        "pii": pii.identifiers, "lines": line_chunks.drop_repeated_chunks, "mix": mixing.mixed, "licenses": licenses.license_matches, "decontam": lambda d: decontam.decontaminate(d, bench), "near": near_dup.near_duplicates,
        "lm": lambda d: lm.scores(d, lm.fit(d)), "media": media.media_columns, "lang": lambda d: langid.identify(d, langid.fit(d)),
    }
    for name, f in operators.items():
        out = f(table).collect()
        assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows), name
        assert f(table.where("false")).count() == 0, name
        if name != "lines":  # there one of equal rows is the first place
            same = Counter(map(str, out))
            assert any(n >= 2 for n in same.values()), name
    assert sorted(Counter(str(r) for r in operators["lm"](table).where("doc_id in (1, 3)").collect()).values()) == [1, 2, 3]
