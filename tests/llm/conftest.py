import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Stands in for the folder all executors share."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        # names that operators use inside must not get in the way
        names = ["digest", "score", "shard", "n", "bucket", "node", "size", "start", "kept", "id", "part", "all"]
        return frame.selectExpr("*", *[f"'x' as {c}" for c in names]) if extra else frame

    return make
