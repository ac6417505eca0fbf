"""Arrays read by byte ranges against the json module."""

import json
import random

import pytest

from jobmarket.schemas import RAW
from jobmarket.sources.json_arrays import read_json_arrays

SMALL = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "400"}


@pytest.fixture
def ranges(spark):
    """Files are cut into ranges of 700 bytes at most."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def records(seed, n):
    rng = random.Random(seed)
    pieces = ['{', '}', '[', ']', '"', "\\", "},{", '}"', "\n", ",", "ü日", "a b", ":", '\\"', "{}", "null", " "]
    text = lambda most: "".join(rng.choice(pieces) for _ in range(rng.randrange(most)))
    rows = []
    for i in range(n):
        row = {"job_title": text(12), "job_url": f"u{i}", "description": text(400 if i % 17 == 0 else 20)}
        if i % 5 == 0:
            row["extra"] = {"deep": [{"x": text(6)}, [[]], {}], "more": {"y": {}}}
        rows.append(row)
    return rows


@pytest.mark.parametrize("cut", [True, False])
def test_records_of_all_ranges(spark, tmp_path, request, cut):
    if cut:
        request.getfixturevalue("ranges")
    want = []
    for i, kwargs in enumerate(({}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}, {"indent": 1, "ensure_ascii": False})):
        name, rows = f"f {i}%+.json", records(i, 200 if i else 3)
        (tmp_path / name).write_text(json.dumps(rows, **kwargs), encoding="utf-8")
        want += [(name, k, r["job_title"], r["job_url"], r["description"], None) for k, r in enumerate(rows)]
    for name, text in {"g.json": "[]", "h.json": " [ \n] ", "i.json": "", "j.json": "  "}.items():
        (tmp_path / name).write_text(text)
    df = read_json_arrays(spark, str(tmp_path), RAW)
    got = [(r.file_name, r.ord, r.job_title, r.job_url, r.description, r.salary) for r in df.collect()]
    assert sorted(got) == sorted(want)
    if cut:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "f 1%+.json")).rdd.getNumPartitions() > 20


@pytest.mark.parametrize(
    "text",
    ['{"job_title": "no array"}', '[{"job_title": "broken"', '[{"job_title": "x"}', '[{"a": 1} {"a": 2}]', '[{"a": 1},, {"a": 2}]', '[{"a": 1},]', '[1, {"a": 1}]',
     '[{"a": 1}] x', 'x [{"a": 1}]', '[{"a": 1}]]', '[{"a" 1}]', '[{"a": 1}, {"a": tru}]', '[{"a": 1}][{"a": 2}]', '{"a": [{"b": 1}]}', '[[{"a": 1}]]', "[1]", '["}"]', "]", "}"],
)
def test_no_array_of_objects(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"job_title": "good"}]')
    assert [(r.file_name, r.job_title) for r in read_json_arrays(spark, str(tmp_path), RAW).collect()] == [("b.json", "good")]


def test_files_are_read_for_their_records_once(spark, tmp_path):
    """What is valid and what is returned come from the same stored records, not from further reads of the files."""
    (tmp_path / "a.json").write_text(json.dumps(records(1, 20)))
    df = read_json_arrays(spark, str(tmp_path), RAW)
    assert df.count() == 20 and not any(f.startswith(tmp_path.as_uri()) or str(tmp_path) in f for f in df.inputFiles())
