import os

import pytest

from threadmill.sources import lines


def write(folder, files):
    os.makedirs(folder)
    for name, text in files.items():
        with open(f"{folder}/{name}", "w", newline="") as f:
            f.write(text)


def test_numbers_over_files_and_splits(spark, tmp_path):
    files = {f"part-{k}.jsonl": "".join(("\n" if (i * k) % 7 == 3 else " \n" if i % 11 == 5 else f'{{"k": {k}, "i": {i}}}\n') for i in range(40 + 300 * k)) for k in range(4)}
    files["part-9.jsonl"] = '\n{"k": 9, "i": 1}'
    write(f"{tmp_path}/t", files)
    expected, ordinal = [], 0
    for name in sorted(files):
        for n, line in enumerate(files[name].split("\n"), 1):
            if line.strip():
                expected.append((name, n, ordinal, line))
                ordinal += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for most in ("128m", "700"):  # whole files, and several splits of each
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            out = lines.numbered_lines(spark, f"{tmp_path}/t").collect()
            assert sorted((r["file"].rpartition("/")[2], r["line"], r["ordinal"], r["value"]) for r in out) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    records = lines.numbered_records(spark, f"{tmp_path}/t", "k int, i int").collect()
    assert sorted((r["ordinal"], f'{{"k": {r["k"]}, "i": {r["i"]}}}') for r in records) == [(e[2], e[3]) for e in expected]


def test_errors_name_file_and_line(spark, tmp_path):
    write(f"{tmp_path}/t", {"a.jsonl": '{"k": 1}\n\n[1]\n{"k": 2}\n', "b.jsonl": '{"k": "x"}\nno json\n{"k": null}\n'})
    with pytest.raises(ValueError, match=r"a.jsonl:3, b.jsonl:1, b.jsonl:2$"):
        lines.numbered_records(spark, f"{tmp_path}/t", "k int")
    kept = lines.numbered_records(spark, f"{tmp_path}/t", "k int", strict=False).collect()
    assert sorted((r["line"], r["ordinal"], r["k"]) for r in kept) == [(1, 0, 1), (3, 5, None), (4, 2, 2)]
    write(f"{tmp_path}/none", {"x.jsonl": ""})
    assert lines.numbered_records(spark, f"{tmp_path}/none", "k int").count() == 0


def test_files_grow_in_number_and_not_in_size(spark, monkeypatch):
    from threadmill.plans import dataset_queries

    written, write = [], dataset_queries.tables.write_jsonl
    monkeypatch.setattr(dataset_queries, "_FILE_BYTES", 20_000)
    monkeypatch.setattr(dataset_queries.tables, "write_jsonl", lambda df, path: (written.append(df.rdd.getNumPartitions()), write(df, path)))
    out = dataset_queries.numbered_lines(spark, "/root/testdata/sf0.001").collect()
    size = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    assert written == [size // 20_000] and written[0] > 5
    assert [r["ordinal"] for r in sorted(out, key=lambda r: r["doc_id"])] == list(range(len(out)))
