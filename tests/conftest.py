import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("statloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Six toy posts, 1 = abusive.
POSTS = [
    ("my dog has flea problems help please", 0), ("maybe not take him to dog park stupid", 1),
    ("my dalmation is so cute I love him", 0), ("stop posting stupid worthless garbage", 1),
    ("mr licks ate my steak how to stop him", 0), ("quit buying worthless dog food stupid", 1),
]


@pytest.fixture(scope="session")
def posts(spark):
    """The toy posts as documents.  Words of one or two letters do not count."""
    rows = [(i, text, label) for i, (text, label) in enumerate(POSTS)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT")


@pytest.fixture(scope="session")
def fish(spark):
    # The toy sea animals.
    rows = [(1, 1, "yes"), (1, 1, "yes"), (1, 0, "no"), (0, 1, "no"), (0, 1, "no")]
    return spark.createDataFrame(rows, "`no surfacing` INT, flippers INT, label STRING")


# The contact-lens rows (age, prescription, astigmatic, tear rate, lens).
LENSES = """\
young	myope	no	reduced	no lenses
young	myope	no	normal	soft
young	myope	yes	reduced	no lenses
young	myope	yes	normal	hard
young	hyper	no	reduced	no lenses
young	hyper	no	normal	soft
young	hyper	yes	reduced	no lenses
young	hyper	yes	normal	hard
pre	myope	no	reduced	no lenses
pre	myope	no	normal	soft
pre	myope	yes	reduced	no lenses
pre	myope	yes	normal	hard
pre	hyper	no	reduced	no lenses
pre	hyper	no	normal	soft
pre	hyper	yes	reduced	no lenses
pre	hyper	yes	normal	no lenses
presbyopic	myope	no	reduced	no lenses
presbyopic	myope	no	normal	no lenses
presbyopic	myope	yes	reduced	no lenses
presbyopic	myope	yes	normal	hard
presbyopic	hyper	no	reduced	no lenses
presbyopic	hyper	no	normal	soft
presbyopic	hyper	yes	reduced	no lenses
presbyopic	hyper	yes	normal	no lenses"""
LENS_FEATURES = ["age", "prescript", "astigmatic", "tearRate"]


@pytest.fixture(scope="session")
def lens_rows():
    return [tuple(line.split("\t")) for line in LENSES.splitlines()]


@pytest.fixture(scope="session")
def lenses(spark, lens_rows):
    return spark.createDataFrame(lens_rows, ", ".join(f"{c} STRING" for c in [*LENS_FEATURES, "label"]))
