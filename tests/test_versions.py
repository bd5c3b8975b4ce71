import pytest
from pyspark.sql import functions as F

from shelfwise.sources import versions as V

SCHEMA = "vec_id bigint, embedding array<float>, name string"


def rows(spark, ids, dim=2, tag="a"):
    return spark.createDataFrame([(i, [float(i)] * dim, f"{tag}{i}") for i in ids], SCHEMA)


def ids_of(df):
    return sorted(r["vec_id"] for r in df.select("vec_id").collect())


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "vec_id bigint")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "index")


def test_every_version_stays_readable(spark, path):
    assert V.create(rows(spark, range(6)), path, index_type="flat") == 1
    at_1 = V.read(spark, path)
    assert V.add(rows(spark, [10, 11]), path) == 2
    assert V.remove(ids(spark, [1, 10, 99, None]), path) == 3
    assert V.add(rows(spark, [1], tag="b"), path) == 4   # an id comes back
    at_4 = V.read(spark, path)
    assert V.compact(spark, path) == 5
    assert V.remove(ids(spark, [0]), path) == 6
    want = {1: [0, 1, 2, 3, 4, 5], 2: [0, 1, 2, 3, 4, 5, 10, 11], 3: [0, 2, 3, 4, 5, 11], 4: [0, 1, 2, 3, 4, 5, 11],
            5: [0, 1, 2, 3, 4, 5, 11], 6: [1, 2, 3, 4, 5, 11]}
    assert {v: ids_of(V.read(spark, path, v)) for v in V.versions(spark, path)} == want
    assert ids_of(at_1) == want[1] and ids_of(at_4) == want[4]     # opened before later changes
    assert V.read(spark, path, 5).where("vec_id = 1").first()["name"] == "b1"
    got = {r["version"]: (r["total_vectors"], r["dimension"], r["data_files"], r["tombstone_files"]) for r in V.stats(spark, path).collect()}
    assert got == {1: (6, 2, 1, 0), 2: (8, 2, 2, 0), 3: (6, 2, 2, 1), 4: (7, 2, 3, 1), 5: (7, 2, 1, 0), 6: (6, 2, 1, 1)}
    assert V.manifest(spark, path)["index_type"] == "flat"


def test_refused_changes_leave_no_version(spark, path):
    V.create(rows(spark, range(3)), path)
    for bad in (rows(spark, [2, 7]), rows(spark, [7], dim=3), rows(spark, [7, 7]),
                spark.createDataFrame([(None, [1.0, 1.0], "x")], SCHEMA), spark.createDataFrame([(8, None, "x")], SCHEMA)):
        with pytest.raises(ValueError):
            V.add(bad, path)
    with pytest.raises(V.VersionConflict):
        V.create(rows(spark, [1]), path)
    with pytest.raises(ValueError):
        V.read(spark, path, 2)
    assert V.versions(spark, path) == [1] and ids_of(V.read(spark, path)) == [0, 1, 2]


def test_an_interrupted_writer_changes_nothing(spark, path, monkeypatch):
    V.create(rows(spark, range(3)), path)

    def dies(*_):
        raise KeyboardInterrupt
    monkeypatch.setattr(V, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        V.add(rows(spark, [5]), path)
    monkeypatch.undo()
    assert V.versions(spark, path) == [1] and ids_of(V.read(spark, path)) == [0, 1, 2]
    assert V.add(rows(spark, [5]), path) == 2 and ids_of(V.read(spark, path)) == [0, 1, 2, 5]


def test_two_writers_of_one_version(spark, path, monkeypatch):
    V.create(rows(spark, range(3)), path)
    real, raced = V._commit, []

    def late(s, p, body):  # another writer commits between this one's check and its commit
        if not raced:
            raced.append(1)
            V.add(rows(spark, [7]), path)
        return real(s, p, body)
    monkeypatch.setattr(V, "_commit", late)
    assert V.add(rows(spark, [8]), path) == 3
    assert ids_of(V.read(spark, path, 2)) == [0, 1, 2, 7] and ids_of(V.read(spark, path)) == [0, 1, 2, 7, 8]
    raced.clear()
    monkeypatch.setattr(V, "_commit", lambda s, p, b: (raced or (raced.append(1), V.add(rows(spark, [9]), path))) and real(s, p, b))
    with pytest.raises(ValueError):   # the other writer has added the same id meanwhile
        V.add(rows(spark, [9]), path)


def test_empty_indexes(spark, path):
    V.create(rows(spark, []), path)
    assert ids_of(V.read(spark, path)) == []
    assert V.add(rows(spark, [1]), path) == 2
    V.remove(ids(spark, [1]), path)
    assert V.compact(spark, path) == 4 and V.read(spark, path).count() == 0
    assert V.add(rows(spark, [1, 2]), path) == 5
    assert V.read(spark, path).agg(F.sum("vec_id")).first()[0] == 3
