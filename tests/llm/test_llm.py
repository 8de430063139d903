"""The training-data operators against brute force on small fixtures, edge cases included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import ann, bpe, katz, langid, licenses, lines, links, mixing, neardup, quality, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall((t or "").translate(AZ))


def make_texts(seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab).capitalize() if rng.random() < 0.1 else rng.choice(vocab) for _ in range(n)) + "."
    origin = text(120)
    out = [None, "", " \t\n ", "one two", "One two", "a", "\n\n", origin, origin, text(6000)]
    for _ in range(60):  # near copies of one text, with one to six words replaced
        ws = origin.split(" ")
        for _ in range(rng.randint(1, 6)):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        out.append(" ".join(ws))
    shared = text(14)
    for _ in range(15):
        out.append(text(rng.randint(5, 60)) + "\n" + shared + "\n" + text(rng.randint(3, 40)))
    out += ["x" * 400, "x" * 400, "ab " * 200, "tail " + shared[:60], shared]
    return out


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = ["b", "a", None, "ç", "hot", "hot", "hot"]
    rows = [(i * 3, t, ["en", "fr", None][i % 3], sources[i % 7], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def clashing(docs):
    """The same rows with columns that operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("id", "key", "rep", "label", "block", "bucket", "t", "size", "u", "v", "line", "words")})


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ------------------------------------------------------------------ near duplicates


def components_by_force(texts, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[3 * i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sets, {i: root(i) for i in ids}


def test_near_duplicates_match_brute_force(docs, texts):
    sets, comp = components_by_force(texts, 80)
    got = by_id(neardup.near_duplicates(clashing(docs), percent=80))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert len(set(comp.values())) < len(comp) - 20


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark, texts):
    t = texts[7]
    rows = [(1, t), (1, t), (2, t), (None, t), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_an_id_with_two_texts_links_through_both(spark):
    rng = random.Random(9)
    make = lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]
    a, b = make(), make()
    near = [*b[:100], "changed", *b[101:]]
    rows = [(1, a), (1, b), (2, near), (3, a), (4, make())]
    got = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    rows = [(0, b), (1, a), (1, b), (2, [*a[:100], "changed", *a[101:]])]
    got = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_membership_products_equal_set_arithmetic():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 200).astype("<u8")) for _ in range(30)]
    raw = [s.tobytes() for s in sets]
    want = [[100 * len(np.intersect1d(a, b)) >= 30 * len(np.union1d(a, b)) for b in sets[10:]] for a in sets[:10]]
    _, sig, _ = neardup.signature(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    side = [{"items": r, "sig": x.view(np.int64).tolist()} for r, x in zip(raw, sig, strict=True)]
    for apart in (np.ones((10, 20), bool), np.eye(10, 20, dtype=bool)):
        got = neardup.all_pairs(side[:10], side[10:], apart, 30)
        assert (got == (np.array(want) & apart)).all()


def test_signature_estimate_is_unbiased(spark):
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(1, 1 << 62, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(1, 1 << 62, 100).astype(np.uint64)]))
    _, sig, _ = neardup.signature(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    row = spark.createDataFrame([(sig[0].view(np.int64).tolist(), sig[1].view(np.int64).tolist())], "x array<long>, y array<long>")
    equal = row.select(neardup.equal_groups("x", "y").alias("n")).first().n / neardup.MINIMA
    assert abs((equal - 0.25) / 0.75 - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15


# ------------------------------------------------------------------ lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lines.edit_distance(a, b, 99) == levenshtein(a, b)
        assert (lines.edit_distance(a, b, 2) > 2) == (levenshtein(a, b) > 2)


def lines_by_force(texts):
    """Classes of normalised lines, linked where SimHashes and edits are close."""
    norm = lambda x: re.sub(lines.NORMAL, " ", x.translate(AZ)).strip()
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if norm(line):
                places[norm(line)].append((3 * i, n))
    names = list(places)
    sim = {}
    for x in names:
        data = np.frombuffer(x.encode(), np.uint8)
        sim[x] = int(lines.line_table(data, np.array([0, len(data)]))[3][0])
    parent = {x: x for x in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            if (sim[a] ^ sim[b]).bit_count() <= lines.DISTANCE and lines.similar(a, b, lines.SIMILARITY_PERCENT):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in names:
        groups[root(x)] += places[x]
    gone = defaultdict(list)
    for g in groups.values():
        for i, n in sorted(g)[1:]:
            gone[i].append(n)
    return {i: sorted(v) for i, v in gone.items()}


def test_line_dedup_matches_brute_force(docs, texts):
    want = lines_by_force(texts)
    got = by_id(lines.without_repeats(clashing(docs)))
    assert {i: r._gone for i, r in got.items() if r._gone} == want
    for k, t in enumerate(texts):
        keep = want.get(3 * k, [])
        assert got[3 * k].text == (t if not keep else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in keep))


def test_lines_with_changed_words_are_found(spark):
    """Edit similarity alone decides: each line beside a copy with every tenth word replaced."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows, pairs = [], 0
    for i in range(300):
        ws = [word() for _ in range(rng.randint(10, 60))]
        copy = list(ws)
        for j in rng.sample(range(len(ws)), len(ws) // 10):
            copy[j] = word()
        a, b = " ".join(ws), " ".join(copy)
        if lines.similar(a, b, 80):
            rows += [(2 * i, a), (2 * i + 1, b)]
            pairs += 1
    got = lines.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert pairs > 250 and all(r.doc_id % 2 == 1 for r in got)
    assert len(got) >= 0.95 * pairs


def test_recall_of_fuzzy_lines_on_the_tables(spark):
    """Of all pairs of different lines of sf0.001 with edit similarity 0.8, by edit distance alone, nine in ten are linked."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    norm = lambda x: re.sub(lines.NORMAL, " ", x).translate(AZ).strip()
    every = sorted({norm(x) for r in docs.collect() for x in (r.text or "").split("\n")} - {""})
    grams = lines.profiles(every).astype(np.float32)
    grams /= np.maximum(np.sqrt((grams**2).sum(axis=1)), 1)[:, None]
    i, j = np.nonzero(np.triu(grams @ grams.T > 0.45, 1))
    size = np.array([len(x) for x in every])
    close = 10 * np.minimum(size[i], size[j]) >= 8 * np.maximum(size[i], size[j])
    i, j = i[close], j[close]
    true = lines.similar_pairs(every, every, i, j, 80)
    one_each = spark.createDataFrame([(n, x) for n, x in enumerate(every)], "doc_id long, text string")
    lost = {r.doc_id for r in lines.repeats(one_each).collect()}
    groups = defaultdict(set)
    parent = list(range(len(every)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(i[true].tolist(), j[true].tolist(), strict=True):
        parent[root(b)] = root(a)
    for x in range(len(every)):
        groups[root(x)].add(x)
    should = {x for g in groups.values() for x in sorted(g)[1:]}
    assert len(should) >= 20 and lost <= should and len(lost) >= 0.9 * len(should)


def test_profile_bound_loses_no_similar_line():
    rng = random.Random(3)
    a = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    b = ["".join(c if rng.random() > 0.12 else rng.choice("xyz") for c in x) for x in a]
    i, j = np.divmod(np.arange(3600), 60)
    want = [5 * (max(len(a[m]), len(b[n])) - levenshtein(a[m], b[n])) >= 4 * max(len(a[m]), len(b[n])) for m, n in zip(i, j, strict=True)]
    assert lines.similar_pairs(a, b, i, j, 80).tolist() == want


@pytest.mark.parametrize("fan", [256, 2])
def test_candidates_share_a_key(spark, fan, monkeypatch):
    """Packed ranges against plain counting, with a key that most classes share, in one step and in two."""
    monkeypatch.setattr(lines, "FAN", fan)
    monkeypatch.setattr(lines, "RANGE", 500)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 1 << 62)), *(int(rng.integers(0, 40)) | (7 << 32 if k == 0 and i % 3 else int(rng.integers(0, 1 << 31)) << 32) for k in range(lines.BANDS // 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "f1 long, sim long, " + ", ".join(f"{k} long" for k in lines.PACKED)).repartition(5)
    held = defaultdict(list)
    for r in df.select("f1", "sim", *[c.alias(f"key{n}") for n, c in enumerate(lines.all_keys())]).collect():
        for k in r[2:]:
            held[k].append((r.f1, r.sim))
    want = {(k, i) for k, v in held.items() if len(v) > 2 or (len(v) == 2 and (v[0][1] ^ v[1][1]).bit_count() <= lines.DISTANCE) for i, _ in v}
    got = [(r.key, r.id) for r in lines.candidates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_word_bound_is_a_bound():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.choice(["a", "bb", "ccc", "dd d"]) for _ in range(rng.randint(1, 12))]
        b = [w for w in a if rng.random() > 0.2] + ["x"] * rng.randint(0, 2)
        x, y = " ".join(a), " ".join(b)
        assert lines.at_most(x, y, 10**6) >= levenshtein(x, y)


def test_lines_edges(spark):
    """Null and repeated ids, a very long line, and an id beside columns of clashing names."""
    long = "word " * 60_000
    rows = [(None, "same line of text here", 1), (1, "same line of text here", 2), (1, "same line of text here", 3), (2, "Same line, of text here", 4), (3, long, 5), (4, long, 6), (5, "", 7), (6, None, 8)]
    got = lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, _d long")).collect()
    by = {r._d: r for r in got}
    assert sorted(by) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [by[k]._gone for k in range(1, 9)] == [None, None, None, [0], None, [0], None, None]
    assert by[6].text == "" and by[5].text == long


def test_line_dedup_of_nothing(empty):
    assert lines.without_repeats(empty).count() == 0


# ------------------------------------------------------------------ mixing


def test_targets_fill_to_the_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights: a 1, b 2, z 3, null 1; a is capped at 30, z at 0; 1980 words are shared 2 to 1
    assert got == {"a": 30.0, "z": 0.0, "b": 1320.0, None: 660.0}


def test_mix_comes_near_targets_and_repeats(docs, texts):
    got = mixing.mix(clashing(docs)).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rows: sorted((r.doc_id, r["size"], r.copies) for r in rows)
    assert key(got) == key(again) and len(got) == len(texts)
    taken, target, longest = Counter(), {}, Counter()
    for r in got:
        assert r.copies <= 3 and r["size"] == len(words(texts[r.doc_id // 3]))
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r["size"])
    for s in target:
        assert target[s] - longest[s] <= taken[s] <= target[s] + 1e-9


def test_mixed_rows_and_empty(docs, empty):
    times = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert times == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
    assert mixing.mix(empty).count() == 0


def test_weights_make_probabilities_unequal(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, "a") for i in range(400)] + [(1000 + i, "w " * 10, "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    share = lambda odd: sum(r.copies for r in got if r.doc_id < 1000 and r.doc_id % 2 == odd)
    assert share(0) > 1.8 * share(1)


# ------------------------------------------------------------------ quality


def test_quality_counts(docs, texts):
    got = by_id(quality.measured(clashing(docs)).select("doc_id", "_q.*"))
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        grams = [tuple(ws[j : j + 5]) for j in range(len(ws) - 4)]
        count, covered = Counter(grams), set()
        for j, g in enumerate(grams):
            if count[g] > 1:
                covered.update(range(j, j + 5))
        full = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[3 * i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(full) - len(set(full)), len(covered))
        assert r.base_failed == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws)) and (not r.kept or not r.base_failed)


def test_quality_rules_by_line(spark):
    good = "This is a sentence with more than ten words in it, as it should be."
    nav = "Home | About | News | Contact | Help | More | Search | Login | Cart | Account | Terms"
    noise = "word### other$$$ thing%%% more&&& less*** again### still$$$ this%%% that&&& here***"
    rows = [(1, good), (2, nav), (3, noise), (4, f"{good}\n{nav}"), (5, f"{good}\n{good[:-1]} and so on.\nClick here"), (6, None)]
    got = by_id(quality.measured(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "_q.*"))
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}  # 5: its sentence repeats
    assert got[5].clean_text == f"{good}\n{good[:-1]} and so on." and got[2].n_failed_lines == 1


def test_phrases_are_whole_words_and_cues_need_short_lines(spark):
    rows = [
        (1, "The blog in question described a design in detail, with more than ten words."),
        (2, "You log in with the key that the office gave you on the first day, then read on."),
        (3, "Log in or subscribe to read more today."),
        (4, "Readers of this catalog in print never saw a cookie, so the baker sent them three of each kind."),
        (5, "We use cookies on this site so that it works better for you and for everyone else who reads it."),
        (6, "if (a > b) { return the first of the two values that were given to it here; }"),
    ]
    got = by_id(quality.measured(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "_q.*"))
    assert {i: r.n_failed_lines for i, r in got.items()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 1}


def test_clean_keeps_columns_of_any_name(spark):
    text = "This is a sentence with more than ten words in it, as it should be."
    df = spark.createDataFrame([(1, text, 5, 6, 7)], "doc_id long, text string, _w long, _l long, _q long")
    assert quality.clean(df).collect() == df.collect()
    df = spark.createDataFrame([(1, "a b c", "s", 1, 2, 3, 4)], "doc_id long, text string, source string, _i long, _n long, _id long, _copies long")
    assert set(mixing.mixed(df).collect()) <= set(df.collect()) and mixing.mixed(df).columns == df.columns


def test_repeated_and_null_ids_in_the_mix(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b", "s"), (None, None, None), (2, "d " * 40, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 5 and all(0 <= r.copies <= 3 for r in got)
    assert mixing.mixed(df).count() == sum(r.copies for r in got)


def test_quality_of_nothing(empty):
    assert quality.clean(empty).columns == empty.columns and quality.clean(empty).count() == 0


# ------------------------------------------------------------------ BPE


def test_bpe_equals_the_library(spark, docs, texts):
    from tokenizers import Tokenizer

    odd = ["ΑΣ Σίσυφος İstanbul it's WE'LL", "<|endoftext|>hi<|startoftext|>", "é   x\x1cy", "日本語テキスト 123 4", "aaaaaaaaaaaaaaaa", "🙂🙂 !!??", "ﬁ ǅ ẞ"]
    library = Tokenizer.from_file(bpe.word_bpe())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + odd)], "doc_id long, text string")
    got = by_id(bpe.encode(df, bpe.word_bpe()))
    back = by_id(bpe.decode(bpe.encode(df, bpe.word_bpe()).select("doc_id", "ids"), bpe.word_bpe()))
    for i, t in enumerate(texts + odd):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids, t
        assert got[i].decoded == back[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_keeps_ids_alone_and_gives_memory_back(monkeypatch):
    """A worker holds four bytes a token of each known piece, not its decoded text as well, and starts without the last task's."""
    codec = bpe.Codec(open(bpe.word_bpe(), encoding="utf-8").read())
    want = codec.encode(["lowest newer <|endoftext|> Wider", None, "lowest"])
    assert want[1] == (b"", "") and all(isinstance(v, bytes) and len(v) % 4 == 0 for v in codec.known.values())
    monkeypatch.setattr(bpe, "KNOWN", 2)
    assert [codec.encode([t])[0] for t in ("lowest newer <|endoftext|> Wider", None, "lowest")] == want
    assert len(codec.known) <= 2 + len(codec.special) + 4


def test_bpe_of_nothing_and_clashing_columns(docs, empty):
    assert bpe.digest(empty, bpe.word_bpe()).count() == 0
    assert bpe.encode(clashing(docs), bpe.word_bpe()).count() == docs.count()


# ------------------------------------------------------------------ repeated passages


def passages_by_force(texts):
    first = {}
    raw = [(3 * i, (t or "").encode()) for i, t in enumerate(texts)]
    for i, b in raw:
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    out = {}
    for i, b in raw:
        lost = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                lost[j : j + 50] = True
        spans = int((lost & ~np.concatenate([[False], lost[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(lost.sum()), spans, np.frombuffer(b, np.uint8)[~lost].tobytes())
    return out


def test_passages_match_brute_force(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_passages(clashing(docs)).collect()}
    assert got == passages_by_force(texts)


@pytest.mark.parametrize("hot", [1000, 3])
def test_buckets_of_passages(texts, hot, monkeypatch):
    """The steps in one process, with passages so common that they are sent window by window."""
    from millrace.llm.blocks import join_parts, split_parts, text_block

    monkeypatch.setattr(repeats, "HOT", hot)
    blocks = []
    for part in np.array_split(np.arange(len(texts)), 3):
        raw = [(texts[i] or "").encode() for i in part]
        off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
        blocks.append(text_block(part * 3, np.frombuffer(b"".join(raw), np.uint8), off))

    def exchange(send, answer):
        sent = defaultdict(list)
        for n, b in enumerate(blocks):
            for k, m in send(n, b):
                sent[k].append((n, m))
        back = defaultdict(dict)
        for k, ms in sent.items():
            for (n, _), r in zip(ms, answer([m for _, m in ms]), strict=True):
                back[n][k] = r
        return back

    marks = exchange(lambda n, b: repeats.tell_runs(2)(b, {}), repeats.settle_runs)
    least = exchange(lambda n, b: repeats.send_strings(2)(b, marks[n]), repeats.earliest)
    got = {}
    for n, b in enumerate(blocks):
        for r in repeats.applied(marks[n], least[n], b).itertuples():
            got[r.doc_id] = (r.n_bytes, r.n_removed, r.n_spans, r.kept)
    assert got == passages_by_force(texts)
    assert split_parts(join_parts([b"a", b"", b"xyz"])) == [b"a", b"", b"xyz"]


def test_two_hops_leave_one_copy_of_replies(docs, monkeypatch):
    """Beyond WIDE blocks messages are not written on their way, and replies not kept twice; 6 GB of texts (2,600 blocks) go in one hop."""
    from millrace.llm import blocks, repeats

    assert 2_600 * 1_300 <= blocks.WIDE * blocks.WIDE
    made, gone = [], []
    monkeypatch.setattr(blocks, "WIDE", 1)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 20_000)
    monkeypatch.setattr(blocks, "stored", lambda df, tag, real=blocks.stored: made.append(tag) or real(df, tag))
    monkeypatch.setattr(blocks, "dropped", lambda *t, real=blocks.dropped: gone.extend(x._stored_at.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in t) or real(*t))
    assert repeats.without_passages(docs).where("n_removed > 0").count()
    assert made == ["passages", "minimizers", "minimizers-back", "minimizers-figures", "intervals", "intervals-back", "intervals-figures"]
    assert gone == ["minimizers", "intervals"]


def test_two_hops_give_the_same(docs, texts, monkeypatch):
    """Messages in two hops, as beyond WIDE blocks."""
    from millrace.llm import blocks

    one = by_id(katz.katz_scores(docs))
    monkeypatch.setattr(blocks, "WIDE", 1)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 3_000)
    monkeypatch.setattr(blocks, "MOST_BLOCK", 3_000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_passages(docs).collect()}
    assert got == passages_by_force(texts)
    two = by_id(katz.katz_scores(docs))
    for i, r in one.items():
        assert r[:5] == two[i][:5] and math.isclose(r.score, two[i].score, rel_tol=1e-9) and math.isclose(r.base_score, two[i].base_score, rel_tol=1e-9)


def test_passages_of_nothing_and_null_ids(spark, empty, texts):
    assert repeats.without_passages(empty).count() == 0
    got = repeats.without_passages(spark.createDataFrame([(None, texts[7]), (1, texts[7]), (1, texts[7])], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


# ------------------------------------------------------------------ language model


def katz_by_force(texts, ids):
    toks = [words(t) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    uni, pair, follows = Counter(), Counter(), Counter()
    for t, h in zip(toks, held, strict=True):
        if not h:
            uni.update(t)
            for a, b in zip(["<begin>", *t], t, strict=False):
                pair[a, b] += 1
                follows[a] += 1
    total = sum(uni.values())
    class_of = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.MOST + 2)]
    du, dp = katz.discounts(class_of(uni)), katz.discounts(class_of(pair))
    unseen = sum((1 - du[min(c, katz.MOST + 1)]) * c for c in uni.values()) / total
    p = lambda w: du[min(uni[w], katz.MOST + 1)] * uni[w] / total if uni[w] else unseen
    mass, freed = defaultdict(float), defaultdict(float)
    for (a, b), c in pair.items():
        mass[a] += p(b)
        freed[a] += (1 - dp[min(c, katz.MOST + 1)]) * c / follows[a]

    def after(a, b):
        if not follows[a]:
            return p(b)
        share, free = (1.0, freed[a]) if freed[a] else (follows[a] / (follows[a] + 0.5), 0.5 / (follows[a] + 0.5))
        c = pair.get((a, b), 0)
        return share * dp[min(c, katz.MOST + 1)] * c / follows[a] if c else free / (1 - mass[a]) * p(b)

    rows = []
    for i, t, h in zip(ids, toks, held, strict=True):
        base = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t)
        rows.append((i, h, len(t), sum(uni[w] > 0 for w in t), total, base, sum(math.log10(after(a, b)) for a, b in zip(["<begin>", *t], t, strict=False))))
    norms = [sum(after(a, w) for w in uni) + after(a, "never seen") for a in list(follows)[:20]]
    return rows, norms


def test_katz_matches_brute_force_and_sums_to_one(docs, texts):
    ids = [3 * i for i in range(len(texts))]
    want, norms = katz_by_force(texts, ids)
    assert np.allclose(norms, 1)
    got = by_id(katz.katz_scores(clashing(docs)))
    for w in want:
        r = got[w[0]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9) and math.isclose(r.score, w[6], rel_tol=1e-9)


def test_katz_of_frequent_words_only(spark):
    """No count is small enough to be discounted: an unknown word still has a probability."""
    rows = [(i, "a b a b") for i in range(40)] + [(next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2), "a zebra")]
    got = katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    uni = katz.Unigrams(30, [0] * 6)
    assert math.isclose(float(uni.p(np.array([20, 10, 0])).sum()), 1)


def test_katz_of_nothing(spark, empty):
    assert katz.katz_scores(empty).count() == 0
    r = katz.katz_scores(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens, r.score) == (None, False, 1, 0, 0.0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_neighbours_on_the_tables(spark, sf):
    """Against brute force, on the embeddings themselves."""
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = defaultdict(set)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.where(ann.usable(F.col("embedding"))).collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = wanted = 0
    for n in np.flatnonzero(ids % 20 == 0):
        s = x @ x[n]
        s[n] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        found, wanted = found + len(best & got[ids[n]]), wanted + len(best)
    assert found >= 0.9 * wanted > 0


def test_neighbours_of_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0} and {r.vec_id for r in got} == {1, 2}


# ------------------------------------------------------------------ language identification


def test_language_identification(spark):
    rng = random.Random(4)
    make = {"aa": "bad cafe dada fab", "bb": "zulu xyzzy wuxu yow"}
    rows = []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choice(make[lang].split()) for _ in range(rng.randint(3, 30))), lang))
    rows += [(1000, None, "aa"), (1001, "123 ... 45", "aa"), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_bags(*langid.lessons(df, "text", "lang", "doc_id", ~langid.held_out()))
    got = by_id(langid.predict(clashing(df), model).withColumn("held", langid.held_out()))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [r for r in got.values() if r.held and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_language_of_nothing(empty, docs):
    assert langid.fit([], []) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty, None).count() == 0


def test_languages_with_long_texts_only_are_learnt(spark):
    rng = random.Random(2)
    word = {"xx": lambda: "".join(rng.choice("abcde") for _ in range(5)), "yy": lambda: "".join(rng.choice("vwxyz") for _ in range(5))}
    rows = [(i, " ".join(word["xx"]() for _ in range(30)), "xx") for i in range(60)] + [(100 + i, " ".join(word["yy"]() for _ in range(5000)), "yy") for i in range(12)]
    df = spark.createDataFrame(rows + rows[:3] + [(999, None, "xx"), (998, "", "yy")], "doc_id long, text string, lang string")
    model = langid.fit_bags(*langid.lessons(df, "text", "lang", "doc_id", ~langid.held_out()))
    got = langid.predict(df, model).where("length(text) > 0").collect()
    assert all(r.lang_pred == r.lang for r in got)


# ------------------------------------------------------------------ licenses


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(50)] + ["licensed", "under", "the", "license", "rights"]
    rows = []
    for i in range(80):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            notice = rng.choice(list(licenses.NOTICES.values())).split()
            if len(notice) > 12 and i % 2:
                notice[3] = "other"
            at = rng.randint(0, len(ws))
            ws[at:at] = notice
        rows.append((i, " ".join(ws)))
    rows += [(100, None), (101, "")]
    got = {(r.doc_id, r.template): (r.containment, r.first_word, r.n_windows) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    norm = lambda t: [w for w in re.split(licenses.GAP, (t or "").lower()) if w]
    want = {}
    for i, t in rows:
        ws = norm(t)
        for name, notice in licenses.NOTICES.items():
            n = norm(notice)
            q = min(5, len(n))
            items = {tuple(n[j : j + q]) for j in range(len(n) - q + 1)}
            s = len(n) - q + 1
            hits = []
            for at in range(len(ws) - len(n) + 1):
                held = {tuple(ws[j : j + q]) for j in range(at, at + s)}
                if 100 * len(held & items) >= 80 * len(items):
                    hits.append((len(held & items) / len(items), -at))
            if hits:
                best = max(hits)
                want[i, name] = (best[0], -best[1], len(hits))
    assert got == want and len(want) > 15


# ------------------------------------------------------------------ nearest neighbours


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 24))
    x = np.repeat(centre, 20, axis=0) + 0.4 * rng.normal(size=(600, 24))
    x *= rng.uniform(0.5, 2, size=(600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, x[0].tolist()), (700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (760, [None] * 24), (780, [1.0, 2.0])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    full = np.vstack([x, x[:1]])
    assert set(got) == {*range(0, 601, 20)}
    hit = 0
    for q, found in got.items():
        s = full @ full[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:20]
        hit += len({v for v, _ in found} & set(want.tolist()))
        assert len(found) == 20 and all(math.isclose(full[v] @ full[q], sc, rel_tol=1e-12) for v, sc in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and q not in [v for v, _ in found]
    assert hit >= 0.9 * 20 * len(got)


def test_neighbours_of_few(spark):
    from pyspark.sql import functions as F

    shape = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], shape), F.lit(True)).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], shape), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 0.5), (2, 2, 0.5)]


@pytest.mark.parametrize("size", [1e170, 1e300, 1e-200])
def test_ann_ends_on_any_finite_vector(spark, size):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    x[17] *= size  # one among ordinary ones, a query as well
    x[40] = x[17]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 17 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 300, 17)) and all(len(v) == 20 for v in got.values())
    if size > 1:
        assert got[17][0] == 40
    every = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    assert ann.nearest(every, F.col("vec_id") % 50 == 0).count() == 6 * 20


def test_a_pair_of_lines_is_tested_alike_in_every_bucket():
    """Links of a large bucket (close_lines) are those of a small one (similar_pairs), misspelt words included."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    base = [" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(12)]
    other = []
    for line in base:
        ws = line.split(" ")
        for k in rng.sample(range(20), 7):
            ws[k] = ws[k][:-1] + "z"
        other.append(" ".join(ws))
    every = base + other
    same = [{"sim": 0, "x": v} for v in every]
    got = lines.close_lines(same, same, np.ones((24, 24), bool), 80)
    i, j = (v.ravel() for v in np.indices((24, 24)))
    assert (got.ravel() == lines.similar_pairs(every, every, i, j, 80, lines.LIKELY)).all()
    near = [lines.similar(a, b, 80) for a, b in zip(base, other, strict=True)]
    assert sum(near) > 6 and [bool(got[k, 12 + k]) for k in range(12)].count(True) >= 0.9 * sum(near)


def test_misspelt_pairs_that_meet_the_similarity_are_links(spark):
    """Letters changed one by one, far apart, move a profile by 6 an edit: such candidates are links as well."""
    rng = random.Random(7)
    rows = []
    for n in range(40):
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100))
        y = "".join(c.upper() if k % 5 == 2 else c for k, c in enumerate(x))
        rows.append((n, n + 100, x, y))
    pairs = spark.createDataFrame(rows, "a long, b long, x string, y string")
    assert all(lines.similar(x, y, 80) for _, _, x, y in rows)
    assert lines.verified(pairs, 80).count() == 40
    made = [({"sim": 0, "x": x}, {"sim": 0, "x": y}) for _, _, x, y in rows]
    near = lines.close_lines([m[0] for m in made], [m[1] for m in made], np.eye(40, dtype=bool), 80)
    assert near.diagonal().all()


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "abc\u00e9\u00df\u6f22\u5b57 \x00"])
def test_distances_of_many_pairs_are_those_of_each(letters, monkeypatch):
    rng = random.Random(9)
    xs, ys = [], []
    for _ in range(400):
        x = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 200])))
        xs.append(x)
        ys.append("".join(c if rng.random() > 0.15 else rng.choice(letters) for c in x if rng.random() > 0.05))
    k = np.arange(400)
    most = np.array([max(len(x), len(y)) // 5 for x, y in zip(xs, ys, strict=True)])
    want = [lines.edit_distance(x, y, int(m)) <= m for x, y, m in zip(xs, ys, most, strict=True)]
    assert 40 < sum(want) < 400 and lines.within(xs, ys, k, k, most).tolist() == want
    monkeypatch.setattr(lines, "CELLS", 3_000)
    monkeypatch.setattr(lines, "FEW", 0)
    assert lines.within(xs, ys, k, k, most).tolist() == want


def test_cells_test_each_pair_once(spark):
    """Two members outside a bucket's largest component meet in one cell, not in both orders."""
    rows = spark.range(200).selectExpr("7L as key", "id", "id as label")
    payload = spark.range(200).selectExpr("id", "struct(id as x, array(7L) as keys) as p")
    found = [(r.a, r.b) for r in links.in_cells(rows, payload, lambda cells: [c[2] for c in cells]).collect()]
    assert len(found) == 199 * 100 and len({frozenset(p) for p in found}) == len(found)


def test_pooled_cells_give_what_each_gives(monkeypatch):
    """Lines of many cells verified together, and distances that are left early, are those of each pair."""
    rng = random.Random(11)
    cells = []
    for n in (3, 1, 9, 30):
        base = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([20, 90, 300, 700]))) for _ in range(n)]
        made = ["".join(rng.choice("abcdef ") if rng.random() < rng.choice([0.1, 0.3]) else c for c in x) for x in base]
        side = [[{"sim": 0, "x": x} for x in v] for v in (base, made)]
        cells.append((*side, np.ones((n, n), bool)))
    for got, (xs, ys, apart) in zip(lines.close_cells(cells, 80), cells, strict=True):
        assert got.tolist() == [[levenshtein(x["x"], y["x"]) * 100 <= 20 * max(len(x["x"]), len(y["x"])) if len(x["x"]) < 100 else lines.similar(x["x"], y["x"], 80) for y in ys] for x in xs]
        assert (lines.close_lines(xs, ys, apart, 80) == got).all()
    a, b = ("".join(rng.choice("ab") for _ in range(3_000)) for _ in range(2))
    looked = []
    monkeypatch.setattr(lines, "least_end", lambda *x, f=lines.least_end: looked.append(x[3]) or f(*x))
    assert lines.edit_distance(a, b, 100) == 101 and max(looked) < 1_500
