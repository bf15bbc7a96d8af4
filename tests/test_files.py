"""Readers over files whose columns differ, and rows that repeat a key."""

import pytest

from longomics.sources import files


def put(base, **texts):
    for name, text in texts.items():
        folder = base / name
        folder.mkdir(parents=True)
        (folder / "x [1].tsv").write_text(text)
    return f"{base}/*/*.tsv"


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_star_columns_follow_each_header(spark, tmp_path):
    glob = put(tmp_path, a="# note\ngene_id\tunstranded\tstranded_first\nENSG1.2\t10\t1\n",
               b="# note\ngene_id\tstranded_first\tunstranded\nENSG1.3\t1\t10\nN_x\t5\t5\n", c="gene_id\textra\ttpm_unstranded\nENSG2.1\t7\t3\n")
    assert rows(files.star_counts(spark, glob), "sample_id", "gene_id", "count") == [("a", "ENSG1", 10.0), ("b", "ENSG1", 10.0), ("c", "ENSG2", 3.0)]


def test_omic_columns_follow_each_header(spark, tmp_path):
    glob = put(tmp_path, a="miRNA_ID\tread_count\treads_per_million_miRNA_mapped\nm1\t4\t2.5\n", b="reads_per_million_miRNA_mapped\tmiRNA_ID\n1.5\tm1\n")
    assert rows(files.mirna(spark, glob), "sample_id", "feature", "value") == [("a", "m1", 2.5), ("b", "m1", 1.5)]


def test_segments_and_mutations_join_columns_by_name(spark, tmp_path):
    glob = put(tmp_path, a="chrom\tstart\nchr1\t5\n", b="start\tchrom\tmean\n6\tchr2\t0.1\n")
    assert rows(files.segments(spark, glob), "sample_id", "chrom", "start") == [("a", "chr1", "5"), ("b", "chr2", "6")]
    got = {tuple(r) for r in files.mutations(spark, glob).select("chrom", "mean").collect()}
    assert got == {("chr1", None), ("chr2", "0.1")}


def test_protein_value_is_named_or_the_last_numeric_of_its_file(spark, tmp_path):
    glob = put(tmp_path, a="AGID\tpeptide_target\tprotein_expression\nA\tp1\t0.5\n", b="peptide_target\tabundance\tremark\np1\t3\tnote\n",
               c="abundance\tpeptide_target\n8\tp1\n")
    assert rows(files.proteins(spark, glob), "sample_id", "feature", "value") == [("a", "p1", 0.5), ("b", "p1", 3.0), ("c", "p1", 8.0)]


def test_sample_tables(spark, tmp_path):
    for name, text in {"GSM1": "ID_REF\tVALUE\ng1\t3\n", "GSM2": "VALUE\tID_REF\n4\tg1\n"}.items():
        (tmp_path / f"{name}.tsv").write_text(text)
    assert rows(files.gsm_tables(spark, f"{tmp_path}/GSM*.tsv"), "sample_id", "gene_id", "count") == [("GSM1", "g1", 3.0), ("GSM2", "g1", 4.0)]
    (tmp_path / "GSM3.tsv").write_text("ID_REF\tother\ng1\t3\n")
    with pytest.raises(ValueError, match="no value column"):
        files.gsm_tables(spark, f"{tmp_path}/GSM*.tsv")
    (tmp_path / "empty.tsv").write_text("")
    with pytest.raises(ValueError, match="no file with a header"):
        files.gsm_tables(spark, f"{tmp_path}/empty.tsv")


@pytest.mark.parametrize("header, sep", [("TXNAME,GENEID", ","), (" GENEID \tTXNAME", "\t"), ("one\ttwo", "\t")])
def test_last_row_of_a_transcript_wins(spark, tmp_path, header, sep):
    swap = header.strip().startswith("GENEID")
    lines = [("t1", "old"), ("t2", "b"), ("t1", "new")]
    (tmp_path / "map.tsv").write_text("\n".join([header, *[sep.join(x[::-1] if swap else x) for x in lines]]) + "\n")
    assert rows(files.tx2gene_table(spark, str(tmp_path / "map.tsv")), "tx_id", "gene_id") == [("t1", "new"), ("t2", "b")]


def test_last_line_wins_across_splits(spark, tmp_path):
    line = '1\ts\ttranscript\t1\t9\t.\t+\t.\tgene_id "{}"; transcript_id "t1";\n'
    (tmp_path / "a.gtf").write_text("".join(line.format(f"g{k}") for k in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        assert rows(files.tx2gene_gtf(spark, str(tmp_path / "a.gtf")), "tx_id", "gene_id") == [("t1", "g399")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_row_of_a_sample_counts(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("Source Name\tCharacteristics[disease]\ns1\tyes\ns1\tno\n")
    cells = spark.createDataFrame([("s1", "g", 1), ("s2", "g", 2)], "sample_id string, gene_id string, count int")
    assert rows(files.with_sdrf(cells, spark, str(tmp_path / "s.tsv")), "sample_id", "disease") == [("s1", "yes"), ("s2", None)]
