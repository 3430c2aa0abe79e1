import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pagelode.llm import spelling

from .util import lower

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute(rows, ratio=10, noise=31, least=7, count=2):
    """word -> (form, root, n, n_near, form_n), by comparing each word with all others."""
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    found = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) < 2 and near(a, b):
                found[a].append(b)
                found[b].append(a)
    form = {}
    for w in words:
        best = min(found[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(found[w]), n.get(form[w]))
    return out


def check(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "en", "clash") for r in rows], "doc_id long, text string, word string, form string")
    got = spelling.variants(docs, **more).collect()
    assert len({r["word"] for r in got}) == len(got)
    expected = brute(rows, **({"ratio": more["ratio"]} if "ratio" in more else {}))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == expected
    return expected


def mutated(r, w, letters):
    i = r.randrange(len(w) + 1)
    return r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcé", "Aaxyzÿ×"])
def test_against_brute_force(spark, letters):
    r = random.Random(letters)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(7, 11))) for _ in range(12)]
    words = base + [mutated(r, w, letters) for w in base for _ in range(6)]
    words += [mutated(r, w, letters) for w in words[12:60] for _ in range(2)]
    rows = []
    for i in range(60):
        some = [r.choice(base) for _ in range(60)] + [r.choice(words) for _ in range(40)]
        rows.append((i - 5, r.choice([" ", "-", "\n", "1"]).join(some)))
    assert len(check(spark, rows)) > 50
    check(spark, rows, ratio=1.5)


def test_chains_of_forms_and_ties(spark):
    words = {"aaaaaaaa": 4000, "aaaaaaab": 400, "aaaaaabb": 40, "aaaaabbb": 4, "zzzzzzzz": 30, "zzzzzzzx": 30, "zzzzzzzy": 3, "zzzzzzz": 2, "zzzzzzzzz": 2}
    rows = [(None, " ".join(w for w, n in words.items() for _ in range(n)))] * 2
    expected = check(spark, rows)
    assert expected["aaaaabbb"][:2] == ("aaaaaabb", "aaaaaaaa") and expected["zzzzzzzy"][0] == "zzzzzzzx" and expected["zzzzzzz"][0] == "zzzzzzzx"


def test_nulls_empties_long_texts_and_short_words(spark):
    rows = [(1, None), (2, ""), (3, " \n1 23 _ short words only"), (3, "repeated " * 3), (3, "repeated " * 3), (None, "repeated"), (4, "x" * 20_000 + " " + "x" * 20_000), (5, "abcdefg " * 50_000)]
    rows += [(6, "Ünïcodé ÜNÏCODÉ ünïcodé ünïcodé"), (7, "straßen STRAßEN straßen中straßen")]
    check(spark, rows)


def test_an_empty_table_and_a_ratio_that_could_lead_in_circles(spark):
    assert check(spark, []) == {}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)
