import pytest

NAMES = "doc_id long, text string, lang string, source string"


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Checkpoints of a local session without the cluster's setting go to a folder of this run."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def prose():
    """A few hundred words without meaning, always the same."""
    import random

    rng = random.Random(5)
    parts = ["ba", "lo", "ren", "ti", "sum", "ka", "vel", "no", "dri", "pha"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(600)]


@pytest.fixture
def odd_rows(spark, prose):
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows, clashing extra columns."""
    long = " ".join(prose * 60)
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (None, "no id here", "en", "b"),
        (4, " ".join(prose[:80]), "en", "b"), (4, " ".join(prose[:80]), "en", "b"), (5, " ".join(prose[:80]), "de", "a"),
        (6, long, "de", "a"), (7, "ünï ☃ \U0001F600 \x85   x", "de", "a"), (None, None, None, None), (None, None, None, None),
    ]
    extra = [(*r, True, 0.5, "x", "y", 1, "z") for r in rows]
    return spark.createDataFrame(extra, NAMES + ", kept boolean, score double, mix string, `row` string, d int, `group` string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], NAMES).repartition(3)


@pytest.fixture
def as_table(spark, tmp_path):
    """Writes frames as tables of a folder, as the registered queries read them."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
