import pytest

from riskloom import session


class Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, name, default=None):
        return self.values.get(name, default)

    def set(self, name, value):
        self.values[name] = value


class Session:
    def __init__(self, master):
        self.conf = Conf(**{"spark.master": master})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(master), "x")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]", "local[2,3]"])
def test_one_machine_gets_a_temporary_folder_once(master):
    own = Session(master)
    first, second = session.shared_folder(own, "x"), session.shared_folder(own, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_rows_of_a_small_file_are_dealt_to_all_cores(spark):
    from unittest.mock import MagicMock

    from riskloom.plans import batch_scoring

    matrix = spark.range(400).coalesce(1)
    seen = MagicMock()
    seen.predict.side_effect = RuntimeError("seen")
    with pytest.raises(RuntimeError, match="seen"):
        batch_scoring.Scorer(None, {"m": seen}, {"m": 1.0}, None, None, None).score(matrix, ["id"])
    given = seen.predict.call_args.args[0]
    assert given.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and given.count() == 400
