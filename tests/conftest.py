import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from srclens.session import local_session
    s = local_session(4, shuffle_partitions=4)
    s.conf.set("srclens.files.partitions", "4")
    yield s
    s.stop()


@pytest.fixture
def files(spark):
    """Build a source_files DataFrame from {path: content}."""
    def make(sources: dict[str, str], repo: str = "repo", lang: str | None = None):
        rows = []
        for path, content in sources.items():
            lg = lang or ("go" if path.endswith(".go") else "python")
            d = path.rsplit("/", 1)[0] if "/" in path else "."
            rows.append((repo, path, d, lg, content))
        return spark.createDataFrame(rows, "repo string, path string, dir string, lang string, content string")
    return make
