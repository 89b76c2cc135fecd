import pytest
from pyspark.sql import functions as F

from seqloom.operators.genome import total_length
from seqloom.operators.kmers import kmer_counts, kmers
from seqloom.operators.reconstruct import genome, segments
from seqloom.sources import fasta, sam
from seqloom.sources import genome as G
from seqloom.sources.store import TABLES, Store, insert_reads
from seqloom.streaming.ingest import ingest, read_stream


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first read\nACGT\nAC\n\n>two\nGGNN\r\n")
    got = {(r.name, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {("one", "ACGTAC"), ("two", "GGNN")}
    fasta.write_fasta(fasta.from_text(spark, ">x\nAC\nGT\n>y\nT"), str(tmp_path / "out"))
    assert {(r.name, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == {("x", "ACGT"), ("y", "T")}
    (tmp_path / "bad.fa").write_text(">one\n>two\nA\n")
    with pytest.raises(Exception, match="empty"):
        fasta.read_fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_fastq(spark, tmp_path):
    text = "@r1 x\nACGT\n+\n@@@@\n@r2\nAC\nGT\n+r2\n!!\n~~\n"
    assert list(fasta.parse(text)) == [("r1", "ACGT", "@@@@"), ("r2", "ACGT", "!!~~")]
    (tmp_path / "a.fq").write_text(text)
    assert {tuple(r) for r in fasta.read_fastq(spark, str(tmp_path / "a.fq")).collect()} == set(fasta.parse(text))
    for bad in ("ACGT", "@r\nAC\n", "@r\nAC\n+\n!", ">a\n"):
        with pytest.raises(ValueError):
            list(fasta.parse(bad))
    fasta.write_fastq(spark.createDataFrame([("a", "ACG", None)], fasta.SCHEMA), str(tmp_path / "q"))
    assert [tuple(r) for r in fasta.read_fastq(spark, str(tmp_path / "q")).collect()] == [("a", "ACG", "III")]


def test_mates(spark):
    one = spark.createDataFrame([(0, "a", "AAC", "123"), (1, "b", "G", "1")], "ordinal long, name string, seq string, qual string")
    two = spark.createDataFrame([(0, "a", "AAC", "123")], "ordinal long, name string, seq string, qual string")
    r = fasta.paired(one, two).collect()
    assert len(r) == 1 and (r[0].seq_2, r[0].qual_2) == ("GTT", "321")


def test_sam_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("q1", 16, "c1", 9, 0.5, "3M1I2D", "ACGT", "IIII", 1, True), ("q2", 4, None, None, None, None, "AC", None, 1, False)],
        "qname string, flag int, rname string, pos long, mapq double, cigar string, seq string, qual string, pair_id long, first boolean",
    )
    contigs = spark.createDataFrame([(0, "c1", 100)], "contig_id long, name string, length long")
    sam.write_sam(rows, contigs, str(tmp_path / "s"))
    got = {r.qname: r for r in sam.read_sam(spark, str(tmp_path / "s")).collect()}
    assert got["q1"].pos == 9 and got["q1"].ref_len == 5 and got["q1"].reverse and not got["q1"].secondary and got["q1"].mapq == 127 / 255
    assert got["q2"].seq == "AC" and got["q2"].qual == "*"
    mates = spark.createDataFrame([("m", 0, "c1", 10, 1.0, "5M", "ACGTA", None, 7, True, 5), ("m", 16, "c1", 40, 1.0, "5M", "ACGTA", None, 7, False, 5)], "qname string, flag int, rname string, pos long, mapq double, cigar string, seq string, qual string, pair_id long, first boolean, ref_len long")
    lines = sorted(r.line.split("\t") for r in sam.paired_lines(mates).collect())
    assert [(x[1], x[6], x[7], x[8]) for x in lines] == [(str(16 + 1 + 128 + 2), "=", "11", "-35"), (str(1 + 64 + 2 + 32), "=", "41", "35")]


def test_genome_folder(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1\nacgtnnac\n>c2\nGGGG\n")
    G.make(spark, str(tmp_path / "g.fa"), str(tmp_path / "g"), "tiny", k=3)
    about, contigs, holes, index = G.load(spark, str(tmp_path / "g"))
    assert about["name"] == "tiny" and [(r.name, r.start, r.length) for r in contigs.orderBy("contig_id").collect()] == [("c1", 0, 8), ("c2", 8, 4)]
    assert [tuple(r) for r in holes.collect()] == [(0, 4, 2)] and index.count() == 8
    spark.createDataFrame([('{"type": "other"}',)], "value string").write.mode("overwrite").text(str(tmp_path / "g" / "description"))
    with pytest.raises(ValueError):
        G.load(spark, str(tmp_path / "g"))


def test_store(spark):
    store = Store(spark, "seqloom_test")
    store.drop_all()
    store = Store(spark, "seqloom_test")
    try:
        assert len(TABLES) == 14 and all(store.read(t).count() == 0 for t in TABLES)
        cols = "id long, run_id long, x long, y long, w long, h long, supporting_reads long, supporting_nt long, ambiguity long"
        store.append("sv_call", spark.createDataFrame([(1, 1, 5, 6, 0, 0, 8, 80, 2), (2, 1, 7, 8, 0, 0, 3, 9, 0), (3, 2, 1, 1, 1, 1, 1, 1, 1)], cols))
        store.append("sv_call_support", spark.createDataFrame([(1, 10), (3, 11)], "call_id long, jump_id long"))
        assert {r.id: (r.score, r.avg_nt) for r in store.calls().collect()} == {1: (4.0, 10.0), 2: (0.0, 3.0), 3: (1.0, 1.0)}
        store.update("sv_call", F.col("id") == 2, {"ambiguity": F.lit(3).cast("long")})
        assert store.calls().filter("id = 2").first().score == 1.0
        store.delete_run(1)
        assert [r.id for r in store.read("sv_call").collect()] == [3] and [r.call_id for r in store.read("sv_call_support").collect()] == [3]
        for _ in range(2):
            store.add_coverage(spark.createDataFrame([(1, 5, 2)], "run_id long, bin_id long, bin_coverage long"))
        assert [tuple(r) for r in store.read("coverage").collect()] == [(1, 5, 4)]
        n = insert_reads(store, "s", spark.createDataFrame([("a", "ACGTACGTACGTACGTACGTAA"), ("b", "ACGTACGTACGTACGTACGTAA")], "name string, seq string"), 1)
        assert store.read("read").filter(F.col("sequencer_id") == n).count() == 2
        assert store.read("k_mer_filter").agg(F.min("num_occ")).first()[0] >= 2
        assert "seqloom_test" in store.schemas()
    finally:
        store.drop_all()


def test_kmers_of_short_long_and_noisy_texts(spark):
    texts = ["", "AC", "ACG", "N" * 5, "ACGTN" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    for stride in (1, 3, 7):
        got = sorted((r.read_id, r.pos, r.kmer) for r in kmers(df, 3, stride=stride).collect())
        assert got == sorted((i, p, t[p : p + 3]) for i, t in enumerate(texts) for p in range(0, len(t) - 2, stride))
    counts = {r.kmer: r.n for r in kmer_counts(df, 3, [], both_strands=True).collect()}
    assert counts["ACG"] == counts["CGT"] == 1 + 600 and not any("N" in k for k in counts)


def test_golden_genome(spark):
    texts = {"chr1": "GATCGTATC", "chr2": "CTCGTCAACAG"}
    contigs = spark.createDataFrame([(0, "chr1", 9, 0, texts["chr1"]), (1, "chr2", 11, 9, texts["chr2"])], "contig_id long, name string, length long, start long, seq string")
    steps = [  # contig order, step, from, to, strands, inserted, read from the other end
        (0, 0, 0, 19, True, True, None, False), (0, 1, 1, 19, False, False, None, True), (0, 2, 4, 7, True, True, None, False),
        (1, 0, 9, 14, True, False, None, False), (1, 1, 10, 15, False, True, None, False), (1, 2, 16, 17, True, True, "TGTT", False), (1, 3, 18, 20, True, True, None, False),
    ]
    rows = [(i, c, o, x, y, 0, 0, f, t, s, m) for i, (c, o, x, y, f, t, s, m) in enumerate(steps)]
    calls = spark.createDataFrame(rows, "id long, ctg_order_id long, order_id long, x long, y long, w long, h long, from_fwd boolean, to_fwd boolean, inserted string, mirrored boolean")
    forward = total_length(contigs)
    got = genome(segments(calls, contigs, forward), contigs, forward).orderBy("ctg_order_id").collect()
    assert "".join(r.seq for r in got) == "GGATCGTCCGACGAAATGTTCA" and [len(r.seq) for r in got] == [8, 14]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">r1\nACGTACGT\n>r2\nAC\nGT\n")
    seen = []
    q = ingest(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda reads, counts, n: seen.append((sorted(r.seq for r in reads.collect()), {r.kmer: r.n for r in counts.collect()})), k=4)
    q.awaitTermination()
    assert seen == [(["ACGT", "ACGTACGT"], {"ACGT": 3, "CGTA": 1, "GTAC": 1, "TACG": 1})]
