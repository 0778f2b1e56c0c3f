"""Where intermediate tables go when no shared folder is named."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from lodestrand.llm import store


def session(master: str, folder: str | None, app: str) -> SimpleNamespace:
    """What store asks of a session; like a running one, it takes no new value of the setting."""
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_named_folder():
    assert store.shared_dir(session("spark://host:7077", "/shared/x/", "a")) == "/shared/x"


def test_local_master_gets_one_folder_for_each_application():
    first, again, other = (store.shared_dir(session("local[2]", None, app)) for app in ("b", "b", "c"))
    assert first == again != other and first.startswith("file://")


def test_cluster_without_folder():
    with pytest.raises(ValueError, match=store.SETTING):
        store.shared_dir(session("spark://host:7077", None, "d"))
