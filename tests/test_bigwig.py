"""bigWig files, written here, read back."""

import struct
import zlib

import pytest

from intervale.sources import bigwig


def written(path, chroms, blocks, order="<", packed=True, fan=2):
    """A file of blocks (chromosome, kind, items): runs (start, end, value), (span, places) or (start, step, span, values), with trees of ``fan`` items a node."""

    def pack(layout, *x):
        return struct.pack(order + layout, *x)

    names = sorted(chroms)
    out = bytearray(64)
    chrom_at, key = len(out), max(len(n) for n in names)
    out += pack("IIIIQQ", bigwig.CHROM_MAGIC, fan, key, 8, len(names), 0)

    def tree(items, leaf, branch):
        """Appends a tree and gives where its root is: the root comes first in the file, so places are counted ahead."""
        levels = [[items[i : i + fan] for i in range(0, len(items), fan)]]
        while len(levels[0]) > 1:
            below = levels[0]
            levels.insert(0, [list(range(i, min(i + fan, len(below)))) for i in range(0, len(below), fan)])
        sizes = [[4 + len(node) * (leaf[0] if k == len(levels) - 1 else branch[0]) for node in level] for k, level in enumerate(levels)]
        at, places = len(out), []
        for level in sizes:
            places.append([])
            for s in level:
                places[-1].append(at)
                at += s

        def span(k, n):
            return levels[k][n] if k == len(levels) - 1 else [x for c in levels[k][n] for x in span(k + 1, c)]

        for k, level in enumerate(levels):
            for node in level:
                out.extend(pack("BBH", int(k == len(levels) - 1), 0, len(node)))
                for x in node:
                    out.extend(leaf[1](x) if k == len(levels) - 1 else branch[1](span(k + 1, x), places[k + 1][x]))

    tree(list(enumerate(names)), (key + 8, lambda x: pack(f"{key}sII", x[1].encode(), x[0], chroms[x[1]])), (key + 8, lambda some, to: pack(f"{key}sQ", some[0][1].encode(), to)))
    data_at, entries = len(out), []
    for chrom, kind, *items in blocks:
        number = names.index(chrom)
        if kind == bigwig.BED_GRAPH:
            runs = items[0]
            low, high, step, span, body = runs[0][0], runs[-1][1], 0, 0, b"".join(pack("IIf", *r) for r in runs)
            n = len(runs)
        elif kind == bigwig.VARIABLE_STEP:
            span, places = items
            low, high, step, body, n = places[0][0], places[-1][0] + span, 0, b"".join(pack("If", *p) for p in places), len(places)
        else:
            low, step, span, values = items
            high, body, n = low + step * (len(values) - 1) + span, b"".join(pack("f", v) for v in values), len(values)
        data = pack("IIIIIBBH", number, low, high, step, span, kind, 0, n) + body
        data = zlib.compress(data) if packed else data
        entries.append((number, low, high, len(out), len(data)))
        out += data
    index_at = len(out)
    out += pack("IIQIIIIQII", bigwig.INDEX_MAGIC, fan, len(entries), entries[0][0], entries[0][1], entries[-1][0], entries[-1][2], index_at, 1, 0)
    tree(entries, (32, lambda x: pack("IIIIQQ", x[0], x[1], x[0], x[2], x[3], x[4])), (24, lambda some, to: pack("IIIIQ", some[0][0], some[0][1], some[-1][0], some[-1][2], to)))
    out[:64] = pack("IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, chrom_at, data_at, index_at, 0, 0, 0, 0, 4096 if packed else 0, 0)
    path.write_bytes(bytes(out))
    return str(path)


CHROMS = {"chr1": 1000, "chr10": 500, "chr2": 800, "chrX": 90, "chrY": 70}
BLOCKS = [
    ("chr1", bigwig.BED_GRAPH, [(0, 10, 1.5), (10, 30, 0.0), (40, 50, 7.0)]), ("chr1", bigwig.VARIABLE_STEP, 5, [(100, 2.0), (120, 3.25)]), ("chr1", bigwig.FIXED_STEP, 200, 10, 4, [1.0, 2.0, float("nan")]),
    ("chr10", bigwig.BED_GRAPH, [(5, 6, 9.0)]), ("chr2", bigwig.BED_GRAPH, [(i, i + 1, float(i % 7)) for i in range(300)]), ("chr2", bigwig.FIXED_STEP, 400, 1, 1, [4.0] * 20), ("chrX", bigwig.BED_GRAPH, [(1, 2, 70000.0)]),
]
RUNS = (
    [("chr1", 0, 10, 1.5), ("chr1", 10, 30, 0.0), ("chr1", 40, 50, 7.0), ("chr1", 100, 105, 2.0), ("chr1", 120, 125, 3.25), ("chr1", 200, 204, 1.0), ("chr1", 210, 214, 2.0), ("chr10", 5, 6, 9.0)]
    + [("chr2", i, i + 1, float(i % 7)) for i in range(300)] + [("chr2", 400 + i, 401 + i, 4.0) for i in range(20)] + [("chrX", 1, 2, 70000.0)]
)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [True, False])
def test_a_written_file_reads_back(spark, tmp_path, order, packed):
    path = written(tmp_path / "a.bw", CHROMS, BLOCKS, order, packed)
    got = bigwig.read_signal(spark, path).where("not isnan(value)").collect()
    assert sorted((r["chrom"], r["start"], r["end"], r["value"]) for r in got) == sorted(RUNS) and {r["file"] for r in got} == {"a.bw"}
    assert {(r["chrom"], r["size"]) for r in bigwig.chromosome_sizes(spark, path).collect()} == set(CHROMS.items())


def test_depths_are_as_of_a_bedgraph(spark, tmp_path):
    path = written(tmp_path / "a.bw", CHROMS, BLOCKS)
    got = bigwig.read_bigwig(spark, "file://" + path, "start").collect()
    assert sorted((r["chrom"], r["start"], r["end"], r["cov"]) for r in got) == sorted((c, s, e, int(v)) for c, s, e, v in RUNS if v >= 1)
    assert {r["track"] for r in got} == {"start"}


def test_wanted_chromosomes_are_all_that_is_read(spark, tmp_path, monkeypatch):
    path = written(tmp_path / "a.bw", CHROMS, BLOCKS)
    paths = [path, written(tmp_path / "b.bw", CHROMS, BLOCKS)]
    for names in (["chr2"], ["chrX", "chr10"], ["none"], ["chrY"], []):
        frame = bigwig.read_signal(spark, paths, names)
        rows = frame.collect()
        assert len(rows) == 2 * sum(r[0] in names for r in RUNS) and {r["chrom"] for r in rows} == set(names) & {r[0] for r in RUNS}
    whole = bigwig.read_signal(spark, paths)
    assert bigwig.read_signal(spark, paths, ["chr2"]).rdd.getNumPartitions() == 2 and whole.rdd.getNumPartitions() == 8
    assert whole.where("chrom = 'chr2'").count() == 640 and whole.count() == 2 * (len(RUNS) + 1)  # one query's filter is not the next one's
    reader = bigwig.BigWigReader({"path": path, "part": "1", "chroms": "chr2"})
    sizes, real = [], bigwig.BigWig._read
    monkeypatch.setattr(bigwig.BigWig, "_read", lambda self, at, n: sizes.append(n) or real(self, at, n))
    parts = reader.partitions()
    assert [(p.chrom, len(p.blocks)) for p in parts] == [("chr2", 1), ("chr2", 1)]  # a partition a block, and no other chromosome's
    few = len(sizes)
    sizes.clear()
    assert len(bigwig.BigWigReader({"path": path, "part": "1"}).partitions()) == len(BLOCKS) and len(sizes) > few  # branches of the index were left out


def test_other_files_raise(spark, tmp_path):
    (tmp_path / "x.bw").write_bytes(b"chr1\t0\t5\n")
    with pytest.raises(Exception, match="no bigWig file"):
        bigwig.read_signal(spark, str(tmp_path / "x.bw")).collect()
