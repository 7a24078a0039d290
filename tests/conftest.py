from __future__ import annotations

import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from unitlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session configurations for one ``with`` block."""

    @contextmanager
    def scoped(**settings):
        settings = {k.replace("__", "."): v for k, v in settings.items()}
        before = {k: spark.conf.get(k, None) for k in settings}
        try:
            for key, value in settings.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    return scoped


def rows(df):
    return [tuple(r) for r in df.collect()]
