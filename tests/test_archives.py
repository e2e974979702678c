"""The archive source and sink."""
import io
import json
import os
import random
import zipfile

import pytest
from hypothesis import given, settings, strategies as st

from convgraph.sources import archives as A


def _zip(path, files, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=5), st.one_of(st.none(), st.integers(), st.text(max_size=8), st.lists(
    st.dictionaries(st.sampled_from("ab]}"), st.text(alphabet='"\\]},[{é', max_size=5), max_size=2), max_size=2)), max_size=3), max_size=6),
    st.integers(1, 40), st.sampled_from([None, 1]), st.booleans(), st.booleans())
def test_records_of_any_block_size(values, block, indent, lines, ascii_only):
    texts = [json.dumps(v, ensure_ascii=ascii_only, indent=indent) for v in values]
    data = "\n".join(texts) if lines else "[" + " , ".join(texts) + "]\n"
    for mark in (b"", b"\xef\xbb\xbf"):
        got = [json.loads(r) for r in A.records(io.BytesIO(mark + data.encode()), "m", block)]
        assert got == values


@pytest.mark.parametrize("data", ["[1]", '"a"', "[{}", "[{}, {", "{", "[{}] x", "[[]]", "nul"])
def test_what_is_not_records_fails_with_its_name(data):
    with pytest.raises(ValueError, match="m.json"):
        list(A.records(io.BytesIO(data.encode()), "m.json", 2))


def test_a_long_record_is_read_in_linear_time():
    record = json.dumps({"a": "x" * 30_000_000})
    assert len(next(A.records(io.BytesIO(("[" + record + "]").encode()), "m", 4096))) == len(record)


def test_one_archive_is_read_by_many_tasks(spark, tmp_dir):
    rng = random.Random(1)
    want = set()
    for a in range(2):
        files = {"statistics.json": "not read", "x/readme.txt": "no"}
        for m in range(20):
            rows = [{"id": f"{a}-{m}-{i}", "t": "%x" % rng.getrandbits(800)} for i in range(rng.randrange(30))]
            files[f"x/{m}.json"] = json.dumps(rows)
            want |= {(f"{a}.zip", f"{m}.json", r["id"]) for r in rows}
        _zip(os.path.join(tmp_dir, f"{a}.zip"), files, zipfile.ZIP_STORED if a else zipfile.ZIP_DEFLATED)
    for path in (tmp_dir, "file:" + tmp_dir, tmp_dir + "/?.zip"):
        df = A.read_archives(spark, path, partition_bytes=4000)
        assert df.rdd.getNumPartitions() > 6
        got = [(r.archive, r.origin_file, json.loads(r.record)["id"]) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
    assert A.read_archives(spark, tmp_dir + "/1.zip").select("archive").distinct().count() == 1


def test_round_trip_empty_folder_and_missing_path(spark, tmp_dir):
    rows = [(f"{i % 3}.json", json.dumps({"i": i, "t": "é\"\n" * (i % 5)})) for i in range(100)]
    df = spark.createDataFrame(rows, "member string, record string").repartition(4)
    assert A.write_archives(df, tmp_dir + "/out", "member", "record") == 100
    back = [(r.origin_file, r.record) for r in A.read_archives(spark, tmp_dir + "/out").collect()]
    assert sorted(back) == sorted(rows)
    for name in os.listdir(tmp_dir + "/out"):
        with zipfile.ZipFile(f"{tmp_dir}/out/{name}") as z:
            counts = json.loads(z.read("statistics.json"))
            assert counts == {n: len(json.loads(z.read(n))) for n in z.namelist() if n != "statistics.json"}
    assert A.write_archives(df.limit(0), tmp_dir + "/none", "member", "record") == 0
    assert A.read_archives(spark, tmp_dir + "/none").count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        A.read_archives(spark, tmp_dir + "/missing").count()
