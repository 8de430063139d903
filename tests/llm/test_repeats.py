"""The merge of op9: what reaches it, and what it tells apart."""

import random

import numpy as np

from millrace.llm import repeats
from millrace.llm.blocks import join_parts, pack_sorted, planes, split_parts


def bucket(strings):
    """The messages of one block with these (key, string, id) to a bucket."""
    strings = sorted(strings)
    key = np.array([k for k, _, _ in strings], np.uint64)
    return [join_parts([pack_sorted(key), np.array([len(x) for _, x, _ in strings], np.uint8).tobytes(), planes(np.array([i for _, _, i in strings], np.int64).view(np.uint64)), b"".join(x for _, x, _ in strings)])]


def minimizer(gram):
    return int(repeats.mix(repeats.grams(np.frombuffer(gram, np.uint8)))[0])


def around(rng, gram, words):
    """Strings of 60 to 79 bytes that hold gram, with letters before and behind it that often are another's too."""
    before, behind = rng.choice(words), rng.choice(words)
    return (before[-rng.randint(20, 30) :] + gram + behind[: rng.randint(20, 29)])[:79]


def test_only_strings_that_may_share_a_window_are_merged(monkeypatch):
    rng = random.Random(4)
    letters = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    gram = letters(repeats.GRAM)
    strings = [(minimizer(gram), letters(29) + gram + letters(29), 100 + i) for i in range(300)]
    shared = strings[7][1]
    strings += [(minimizer(gram), b"xx" + shared[2:-3] + b"yyy", 5)]
    merged, merge = [], repeats.merged_intervals
    monkeypatch.setattr(repeats, "merged_intervals", lambda data, length: merged.append(len(length)) or merge(data, length))
    n_runs, _, value = split_parts(repeats.earliest(bucket(strings))[0])
    assert merged == [2]
    # the windows of the two strings that lie within the shared bytes get the smaller id, all others their own
    assert sorted(n_runs) == [1] * 300 + [3]


def test_windows_get_the_least_id_by_brute_force():
    rng = random.Random(9)
    for gram in (b"abcdefghijklmnopqrstuvwx"[: repeats.GRAM], b"a" * repeats.GRAM):
        words = [bytes(rng.choice(b"ab") for _ in range(15)) + bytes(rng.choice(b"ab") if rng.random() < 0.1 else 97 for _ in range(15)) for _ in range(12)]
        strings = sorted({around(rng, gram, words): None for _ in range(200)})
        rows = sorted((minimizer(gram), x, rng.randint(0, 999)) for x in strings)
        least = {}
        for _, x, i in rows:
            for a in range(len(x) - repeats.LENGTH + 1):
                w = x[a : a + repeats.LENGTH]
                least[w] = min(i, least.get(w, i))
        n_runs, stretch, value = split_parts(repeats.earliest(bucket(rows))[0])
        got = np.repeat(np.frombuffer(value, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel(), np.frombuffer(stretch, np.uint8))
        want = [least[x[a : a + repeats.LENGTH]] for _, x, _ in rows for a in range(len(x) - repeats.LENGTH + 1)]
        assert got.tolist() == want and len(least) < len(want)


def test_intervals_of_strings_told_apart():
    rng = random.Random(2)
    whole = bytes(rng.choice(b"ab") for _ in range(70))
    strings = [whole, whole[5:60], bytes(rng.choice(b"cd") for _ in range(64)), whole[10:] + b"b"]
    length = np.array([len(x) for x in strings])
    got = repeats.merged_intervals(np.frombuffer(b"".join(strings), np.uint8), length)
    begin, by = np.cumsum(length + 1) - length - 1, {}
    for x, b in zip(strings, begin, strict=True):
        for a in range(len(x) - repeats.LENGTH + 1):
            by.setdefault(x[a : a + repeats.LENGTH], []).append(int(got[b + a]))
    assert all(len(set(v)) == 1 and (v[0] < 0) == (len(v) == 1) for v in by.values())
    named = [v[0] for v in by.values() if v[0] >= 0]
    assert len(named) == len(set(named)) and (got >= 0).sum() == sum(len(v) for v in by.values() if len(v) > 1)
