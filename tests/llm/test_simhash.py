import random

import xxhash

from speechtables.llm import simhash
from speechtables.llm import components as component_steps
from speechtables.llm.components import components
from tests.llm.helpers import documents, least_reachable, odd_texts, prose


def plain_print(text: str | None, words: int = 3) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [t for t in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in lowered).split(" ") if t]
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints: list[int]) -> list[int]:
    return least_reachable(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)


def test_texts_against_loops(spark):
    draw = random.Random(3)
    base = prose(draw, 300)
    texts = [*odd_texts(), base, base, base.replace("w7x", "w8x", 1), base + " tail", prose(draw, 40)]
    rows = simhash.near_duplicate_classes(documents(spark, texts, "fingerprint")).collect()
    got = {r["doc_id"]: (r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in rows}
    prints = [plain_print(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == prints
    assert [got[i][1] for i in range(len(texts))] == plain_classes(prints)


def test_dense_groups_in_tiles_keep_all_links(spark):
    draw = random.Random(11)
    centres = [draw.getrandbits(64) for _ in range(4)]
    prints = [draw.getrandbits(64) for _ in range(60)]
    for centre in centres:
        for _ in range(110):
            value = centre
            for _ in range(draw.randrange(0, 6)):
                value ^= 1 << draw.randrange(64)
            prints.append(value)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(signed, "doc_id bigint, fingerprint bigint")
    expected = plain_classes(prints)
    for tile in (4096, 16):
        got = {r["doc_id"]: r["component_id"] for r in simhash.classes(frame, tile).collect()}
        assert [got[i] for i in range(len(prints))] == expected


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicate_classes(documents(spark, [])).count() == 0
    rows = simhash.near_duplicate_classes(documents(spark, ["a b c d", "a b c d", "other text here now"], ids=[None, 4, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_components_of_chains_loops_and_stars(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (None, 3)]
    draw.shuffle(edges)
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 200}


def test_rounds_write_as_many_files_as_their_edges_need(spark, monkeypatch):
    files, plain = [], component_steps.cut_lineage
    monkeypatch.setattr(component_steps, "cut_lineage", lambda df: files.append(df.rdd.getNumPartitions()) or plain(df))
    monkeypatch.setattr(component_steps, "_TASK_EDGES", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(i, i + 1) for i in range(20)], "u bigint, v bigint")
        got = {r["node"]: r["root"] for r in components(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: 0 for i in range(21)}
    assert max(files[1:]) <= 2 < files[0]
