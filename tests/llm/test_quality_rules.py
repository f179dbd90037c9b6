import base64
import re

import numpy as np

from talus.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_statistics_match_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["a", "bé", "字#", "d|e", "\n", "\n", "x\ty", "same line"]
    texts = [None, "", "\n\n", " ", "a\na\n a\na", "one two three four five six seven eight " * 3]
    texts += [" ".join(rng.choice(words, rng.integers(0, 120))) for _ in range(60)]
    rows = [(i, t, 1.0, True) for i, t in enumerate(texts)] + [(None, "q", 0.0, False), (1, "", 0.0, False)]
    got = q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept double, verdict boolean")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["id"]] if r["id"] is not None else "q"
        want = brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_compression_bands(spark):
    rng = np.random.default_rng(4)
    syllables = ["ka", "lo", "mi", "ren", "tas", "ou", "per", "sin", "dov", "el"]
    prose = lambda n: " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(c) for c in rng.integers(33, 126, 12)) for _ in range(n))
    rows = [
        (1, prose(60)), (2, prose(600)), (3, prose(20_000)), (4, "drum beat " * 400), (5, noise(400)),
        (6, prose(3000) + " " + noise(3000)), (7, noise(1) * 9000), (8, prose(30)),
    ]
    got = {r["id"]: r for r in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["verdict"] == "ok"} >= {1, 8}
    assert got[4]["verdict"] == got[7]["verdict"] == "repetitive"
    assert got[5]["verdict"] == got[6]["verdict"] == "incompressible"
    assert q.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_last_chunk_is_judged():
    rng = np.random.default_rng(5)
    syllables = ["ka", "lo", "mi", "ren", "tas", "ou", "per", "sin", "dov", "el"]
    long = " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(2000)).encode()
    prose = long[: q.CHUNK]
    junk = base64.b64encode(rng.bytes(2925))
    coder = q.zstandard.ZstdCompressor(level=q.LEVEL)
    share, n_chunks, n_stray, verdict = q.compression(coder, prose + junk)
    assert q.band(q.CHUNK + len(junk))[0] <= share <= q.band(q.CHUNK + len(junk))[1]
    assert (n_chunks, n_stray, verdict) == (2, 1, "incompressible")
    assert q.compression(coder, long[: q.CHUNK + 2000])[1:] == (2, 0, "ok")


def test_verdicts_match_brute_force(spark):
    rng = np.random.default_rng(8)
    words = ["ka", "loren", "mi", "tasou", "persin", "dov"]
    texts = [None, "", "x"] + [" ".join(rng.choice(words, rng.integers(1, 4000))) + rng.bytes(int(rng.integers(0, 3000))).hex() * int(rng.integers(0, 3)) for _ in range(60)]
    got = {r["id"]: r for r in q.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    share = lambda b: len(q.zstandard.compress(b, q.LEVEL)) / len(b)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        parts = [raw[a : a + 4096] for a in range(0, len(raw), 4096)] if len(raw) > 4096 else []
        low = sum(share(c) < q.band(len(c))[0] for c in parts)
        high = sum(share(c) > q.band(len(c))[1] for c in parts)
        want = "ok"
        if raw and (share(raw) < q.band(len(raw))[0] or low > 0.2 * len(parts)):
            want = "repetitive"
        elif raw and (share(raw) > q.band(len(raw))[1] or high > 0.2 * len(parts)):
            want = "incompressible"
        assert (got[i]["verdict"], got[i]["n_stray_chunks"], got[i]["n_chunks"]) == (want, low + high, len(parts))
    assert len({r["verdict"] for r in got.values()}) > 1
