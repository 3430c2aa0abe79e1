import random
import zlib

from pagelode.llm import decontam, quality, sharding
from pagelode.llm.common import work_path

from .util import hard_texts, lower, table


def brute_hits(text, items, n=10):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = find(text), set(), set()
    for owner, item in items:
        iw = find(item)
        size = min(n, len(iw))
        for a in range(len(iw) - size + 1 if iw else 0):
            for s in range(len(w) - size + 1):
                if w[s : s + size] == iw[a : a + size]:
                    hit.update(range(s, s + size))
                    found.add(owner)
    return len(w), len(hit), sorted(found)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "short item"),
    (3, "three four five six seven eight nine ten eleven twelve thirteen"),
    (4, None),
    (5, "..."),
    (6, "a a a a a a a a a a a"),
    (22, "short item"),
]
TEXTS = [
    None,
    "",
    "x one TWO three, four five-six seven eight nine ten y",
    "one two three four five six seven eight nine",
    "a short item and a short  item; item",
    "a " * 30,
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen short item",
]


def test_hits_against_brute_force(spark):
    docs = table(spark, [*TEXTS, *hard_texts()])
    rows = {r["doc_id"]: r for r in decontam.marked(docs, bench(spark, ITEMS)).collect()}
    small = {r["doc_id"]: r for r in decontam.marked(docs, bench(spark, ITEMS), block_words=12).collect()}
    sums = {r["doc_id"]: r for r in decontam.digests(docs, bench(spark, ITEMS)).collect()}
    for i, t in enumerate([*TEXTS, *hard_texts()]):
        n, hit, items = brute_hits(t, [(str(k), x) for k, x in ITEMS])
        for found in (rows, small):
            spans = decontam._merged([(s["a"], s["b"]) for s in found[i]["hit_spans"]])
            assert (sum(b - a for a, b in spans), sorted(found[i]["hit_items"])) == (hit, items), (i, t)
        assert (sums[i]["n_words"], sums[i]["n_hit"], sums[i]["n_items"], sums[i]["contaminated"]) == (n, hit, len(items), hit > 0)


def test_many_blocks_odd_items_and_repeated_rows(spark):
    items = [(None, "seven words that stand in no list"), *ITEMS, *((100 + i, f"item {i} has its own words a{i} b{i} c{i} d{i} e{i} f{i} g{i}") for i in range(12))]
    texts = ["x seven words that stand in no list y", items[-1][1] + " and " + items[-5][1], items[-1][1] + " and " + items[-5][1], None, "none"]
    docs = table(spark, texts, ids=[1, 2, 2, 3, None]).withColumnRenamed("lang", "key")
    one, many = decontam.marked(docs, bench(spark, items)), decontam.marked(docs, bench(spark, items), block_words=14)
    assert one.schema == many.schema
    rows = lambda df: sorted(((r["doc_id"], r["key"], decontam._merged([(x["a"], x["b"]) for x in r["hit_spans"]]), r["hit_items"]) for r in df.collect()), key=repr)
    assert rows(one) == rows(many)
    got = {r[0]: r[2:] for r in rows(one)}
    assert got[1] == ([(1, 8)], []) and got[2][1] == ["107", "111"] and got[3] == ([], []) and got[None] == ([], [])


def test_spans_are_cut(spark):
    long = "clean words before, " * 5
    docs = table(spark, [long + ITEMS[0][1] + " after", ITEMS[0][1], "nothing here", None]).withColumnRenamed("lang", "hit_items")
    out = decontam.decontaminated(docs, bench(spark, ITEMS))
    assert out.schema == docs.schema
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {0: long + " after", 2: "nothing here", 3: None}
    assert decontam.decontaminated(docs, bench(spark, [])).count() == 4
    assert decontam.digests(table(spark, []), bench(spark, ITEMS)).count() == 0


def test_statistics_of_a_text():
    n, chars, symbols, dup, rep, keys, _ = quality.text_stats("a b c\na b c\n\n# é b".encode(), b"h")
    assert (n, chars, symbols, dup, rep) == (9, 9, 1, 1, 6) and len(keys) == 2
    assert quality.repeated_words(b"x x x x".split()) == 4 and quality.repeated_words([]) == 0


def test_boilerplate_lines_go_and_copies_stay(spark):
    own = lambda i: "\n".join(" ".join(f"d{i}l{j}w{k}" for k in range(12)) for j in range(8))
    texts = [own(i) + "\nShare this PAGE with your  friends" for i in range(12)]  # clean, with a common line
    texts += [own("copy")] * 15  # clean copies
    texts += ["share this page with your friends\n" + "a b c d e f g h i j " + str(i) for i in range(3)]  # too short
    depleted = "\n".join(["share this page with your friends"] * 1 + [" ".join(f"boiler{k}w{j}" for j in range(8)) for k in range(9)])
    texts += [own(f"x{i}") + "\n" + depleted for i in range(12)] + [depleted]
    docs = table(spark, texts).withColumnRenamed("lang", "_content")
    rows = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert all(rows[i]["kept"] for i in range(27)) and rows[0]["n_left"] == rows[0]["n_words"] - 6
    assert not any(rows[i]["kept"] for i in range(27, 30)) and not rows[42]["kept"] and not rows[42]["base_failed"]
    out = quality.filtered(docs)
    assert out.schema == docs.schema
    kept = {r["doc_id"]: r for r in out.collect()}
    assert kept[0]["text"] == own(0) and kept[0]["n_chars"] == len(own(0)) and kept[12]["text"] == own("copy")


def test_mostly_boilerplate_pages_are_rejected(spark):
    line = lambda name, n: " ".join(f"{name}w{k}" for k in range(n))
    shared = "\n".join(line(f"s{j}", 12) for j in range(10))
    texts = [shared + "\n" + line(f"own{i}", 80) for i in range(30)]  # 60 percent shared
    pool = [line(f"p{j}", 12) for j in range(40)]
    r = random.Random(2)
    texts += ["\n".join(r.sample(pool, 16)) for _ in range(60)]  # put together from shared lines
    near = [line(f"n{j}", 12) for j in range(20)]
    texts += ["\n".join(near[:19] + [near[19] + f" x{i}"]) for i in range(30)]  # near copies
    docs = table(spark, texts)
    rows = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert not any(rows[i]["base_failed"] for i in rows)
    assert not any(rows[i]["kept"] for i in range(90)) and all(rows[i]["n_left"] == 80 for i in range(30))
    assert all(rows[i]["kept"] and rows[i]["n_left"] == rows[i]["n_words"] for i in range(90, 120))
    assert sorted(r["doc_id"] for r in quality.filtered(docs).collect()) == list(range(90, 120))


def test_a_host_of_the_same_lines_is_rejected(spark):
    line = lambda name, n: " ".join(f"{name}w{k}" for k in range(n))
    shared = "\n".join(line(f"s{j}", 12) for j in range(8))
    texts = [shared + (f"\npage id {i}" if i % 2 else "") for i in range(400)] + ["\n".join(line(f"clean{i}l{j}", 12) for j in range(8)) for i in range(5)]
    rows = {r["doc_id"]: r for r in quality.judged(table(spark, texts), copies_once=False).collect()}
    assert not any(rows[i]["kept"] or rows[i]["base_failed"] for i in range(400)) and all(rows[i]["kept"] for i in range(400, 405))
    assert [rows[i]["n_left"] for i in (0, 1)] == [0, 3]
    assert quality.filtered(table(spark, texts), copies_once=False).count() == 5


def test_quality_hard_rows(spark):
    docs = table(spark, [*hard_texts(), None, None], sources=[None, "a"] * ((len(hard_texts()) + 2) // 2) + ["b"] * (len(hard_texts()) % 2))
    assert quality.judged(docs).count() == docs.count() and quality.judged(table(spark, [])).count() == 0
    assert quality.filtered(table(spark, [])).count() == 0


def test_shards(spark, tmp_path):
    texts = [*hard_texts(), *("t%d " % i * (i % 50) for i in range(2000))]
    docs = table(spark, texts).withColumnRenamed("lang", "slot")
    got = sharding.shard_table(docs, 4, 256).collect()
    assert len(got) == len(texts)
    by, load = {}, {}
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        by.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(by) == 4
    assert max(load.values()) - min(load.values()) <= 110_000  # the longest text
    sharding.write_shards(sharding.shard_table(docs, 4, 256), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 4
    assert sharding.shard_table(table(spark, []), 4).count() == 0


def test_the_map_is_versioned_and_edited_little(spark):
    sizes = {s: (100 + s % 7, 1) for s in range(512)}
    one = sharding.build_map(sizes, 8, 512)
    two = sharding.rebalance(one, sizes, 9)
    moved = [s for s in one if one[s] != two[s]]
    assert all(two[s] == 8 for s in moved) and abs(len(moved) - 512 / 9) < 12
    sizes[3] = (5000, 1)
    three = sharding.rebalance(one, sizes, 8, 0.05)
    load = [sum(sizes[s][0] for s in three if three[s] == k) for k in range(8)]
    before = [sum(sizes[s][0] for s in one if one[s] == k) for k in range(8)]
    assert max(load) < max(before) and sum(one[s] != three[s] for s in one) < 100
    path = work_path(spark, "map")
    sharding.store_map(spark, one, sizes, path, 1)
    sharding.store_map(spark, two, sizes, path, 2)
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path, 1).collect()} == one
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path, 2).collect()} == two


def brute_shards(rows, n_shards, n_slots):
    """(id, size, crc) -> shard by the map, and how many rows come before its slot: rows of distinct (id, text)."""
    import hashlib

    slots = {}
    for i, t in rows:
        data = (t or "").encode()
        key = f"{'null' if i is None else i}|{zlib.crc32(data)}|0"
        slots.setdefault(int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % n_slots, []).append((i is None, i or 0, zlib.crc32(data), len(data) + 1, i))
    load, shard = [0] * n_shards, {}
    for slot in sorted(range(n_slots), key=lambda x: (-sum(r[3] for r in slots.get(x, [])), x)):
        shard[slot] = load.index(min(load))
        load[shard[slot]] += sum(r[3] for r in slots.get(slot, []))
    out, count = [], [0] * n_shards
    for slot in sorted(slots):
        for r in sorted(slots[slot], key=lambda r: r[:3]):
            out.append((r[4], r[3], r[2], shard[slot], count[shard[slot]], slot))
            count[shard[slot]] += 1
    return out


def test_shards_against_brute_force(spark):
    rows = list(enumerate(hard_texts())) + [(3, "another text of the id"), (None, "no id"), (None, "none either"), (None, None)]
    docs = table(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = [tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot", "vslot")) for r in sharding.shard_table(docs, 5, 64).collect()]
    assert sorted(got, key=repr) == sorted(brute_shards(rows, 5, 64), key=repr)


def test_the_law_holds_where_rows_repeat(spark):
    rows = [(7, "x" * 100)] * 5000 + [(i, "y" * (50 + i % 30)) for i in range(1000, 2001)] + [(None, "z")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard_table(docs, 16).collect()
    load, slots = {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and len(load) == 16 and max(load.values()) - min(load.values()) <= 101
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_a_grown_map_moves_few_rows(spark):
    docs = table(spark, ["t%d " % i * (1 + i % 50) for i in range(3000)])
    slotted, path = sharding.with_slots(docs), work_path(spark, "map")
    sizes = sharding.slot_sizes(slotted)
    sharding.store_map(spark, sharding.build_map(sizes, 16), sizes, path, 1)
    one = {r["doc_id"]: r["shard"] for r in sharding.with_shards(slotted, sharding.load_map(spark, path, 1)).collect()}
    rows = sharding.with_shards(slotted, sharding.edited_map(spark, path, 1, 17)).collect()
    moved = [r for r in rows if r["shard"] != one[r["doc_id"]]]
    load, slots = {}, {}
    for r in rows:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert moved and sum(r["shard"] == 16 for r in moved) > 0.8 * len(moved) and len(moved) < 3000 / 12
    assert max(load.values()) < 1.03 * sum(load.values()) / 17 and all(sorted(x) == list(range(len(x))) for x in slots.values())
