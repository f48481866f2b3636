"""Binary maps: the codec, and files read by blobs."""

import random
import xml.sax.saxutils as sax

from rideframe.sources import pbf, readers


def drawn(n=700, seed=3):
    rng = random.Random(seed)
    nodes = [(rng.randrange(1, 1 << 40), round(rng.uniform(-90, 90), 7), round(rng.uniform(-180, 180), 7), {"barrier": "gate", "name": "Ä & <b>"} if i % 5 == 0 else {}) for i in range(n)]
    ways = [(i + 1, [rng.choice(nodes)[0] for _ in range(rng.randint(0, 9))], {"highway": rng.choice(["primary", "track"]), "name": f"way {i}"} if i % 3 else {}) for i in range(n // 4)]
    return nodes, ways


def write(path, nodes, ways, each):
    with open(path, "wb") as out:
        out.write(pbf.framed(b"\x0a\x04none", b"OSMHeader"))
        for k in range(0, len(nodes), each):
            out.write(pbf.framed(pbf.encoded(nodes[k : k + each])))
        for k in range(0, len(ways), each):
            out.write(pbf.framed(pbf.encoded(ways=ways[k : k + each])))


def test_varints_of_all_sizes():
    values = [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1]
    assert pbf.varints(b"".join(map(pbf._varint, values))).tolist() == values
    assert pbf.varints(b"").tolist() == []
    numbers = [0, -1, 1, -(2**40), 2**40]
    assert pbf.signed(pbf.varints(b"".join(pbf._varint(pbf._zigzag(x)) for x in numbers))).tolist() == numbers


def test_files_are_read_by_blobs(spark, tmp_path):
    nodes, ways = drawn()
    write(tmp_path / "a.osm.pbf", nodes[:400], ways[:100], 50)
    write(tmp_path / "b.osm.pbf", nodes[400:], ways[100:], 1000)
    df = pbf.read_pbf(spark, str(tmp_path), 2)
    assert df.rdd.getNumPartitions() > 4  # one file in several tasks
    rows = df.collect()
    got = sorted((r.id, round(r.lat, 7), round(r.lon, 7), tuple(sorted(r.tags.items()))) for r in rows if r.kind == "node")
    assert got == sorted((i, a, b, tuple(sorted(t.items()))) for i, a, b, t in nodes)
    got = sorted((r.id, r.nodes, tuple(sorted(r.tags.items()))) for r in rows if r.kind == "way")
    assert got == sorted((i, refs, tuple(sorted(t.items()))) for i, refs, t in ways)
    (tmp_path / "empty.pbf").write_bytes(b"")
    assert pbf.read_pbf(spark, str(tmp_path / "empty.pbf")).count() == 0


def test_single_nodes_offsets_and_raw_blobs():
    """Nodes that are not dense, a block with its own granularity and offsets, and a blob that is not packed."""
    node = pbf._field(pbf.NODE, pbf._field(1, pbf._zigzag(-7)) + pbf._field(2, b"\x01") + pbf._field(3, b"\x02") + pbf._field(8, pbf._zigzag(5)) + pbf._field(9, pbf._zigzag(-5)))
    block = pbf._field(1, b"".join(pbf._field(1, s) for s in (b"", b"k", b"v"))) + pbf._field(2, node) + pbf._field(17, 1000) + pbf._field(19, 2_000_000_000) + pbf._field(20, (1 << 64) - 1_000_000_000)
    assert pbf.decoded(pbf._field(1, block)) == [("node", -7, 1e-9 * 2_000_005_000, 1e-9 * -1_000_005_000, None, [("k", "v")])]


def test_the_same_map_in_xml_and_binary(spark, tmp_path):
    nodes, ways = drawn(200, 9)
    write(tmp_path / "map.osm.pbf", nodes, ways, 30)
    tag = lambda t: "".join(f"<tag k={sax.quoteattr(k)} v={sax.quoteattr(v)}/>" for k, v in t.items())
    body = "".join(f'<node id="{i}" lat="{a}" lon="{b}">{tag(t)}</node>\n' for i, a, b, t in nodes) + "".join(f'<way id="{i}">' + "".join(f'<nd ref="{x}"/>' for x in refs) + tag(t) + "</way>\n" for i, refs, t in ways)
    (tmp_path / "map.osm").write_text(f"<osm>\n{body}</osm>")
    binary = pbf.read_pbf(spark, str(tmp_path / "map.osm.pbf"))
    plain = lambda df: sorted((r.way_id, tuple(r.nodes), tuple(sorted(r.tags.items()))) for r in df.collect())
    assert plain(pbf.map_ways(binary)) == plain(readers.read_osm_ways(spark, str(tmp_path / "map.osm")))
    place = lambda df: sorted((r.node_id, round(r.lat, 7), round(r.lon, 7)) for r in df.collect())
    xml = readers.read_osm_nodes(spark, str(tmp_path / "map.osm"))
    assert place(pbf.map_nodes(binary)) == place(xml)
    columns = ["u", "v", "way_id", "dir", "seq"]
    one = readers.way_edges(pbf.map_ways(binary), pbf.map_nodes(binary).drop("tags")).select(*columns)
    two = readers.way_edges(readers.read_osm_ways(spark, str(tmp_path / "map.osm")), xml).select(*columns)
    assert one.count() > 100 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_blobs_of_a_table_hold_all_rows_and_kinds(spark):
    """Blobs of mixed kinds, written and read by columns; other kinds are not read where one is asked for."""
    nodes, ways = drawn(300, 5)
    rows = [("node", i, a, b, None, t or None) for i, a, b, t in nodes] + [("way", i, None, None, refs, t) for i, refs, t in ways]
    random.Random(1).shuffle(rows)
    blobs = pbf.table_blobs(spark.createDataFrame(rows, pbf.SCHEMA), 40)
    plain = lambda df: sorted((r.kind, r.id, r.nodes, tuple(sorted(r.tags.items()))) for r in df.collect())
    want = sorted((kind, i, refs, tuple(sorted((t or {}).items()))) for kind, i, _, _, refs, t in rows)
    assert plain(pbf.blob_table(blobs)) == want
    for kind in pbf.KINDS:
        assert plain(pbf.blob_table(blobs, (kind,))) == [r for r in want if r[0] == kind]
