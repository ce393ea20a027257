import importlib
from pathlib import Path

import pytest

from heaplens.llm import op6_media
from heaplens.llm.common import filesystem


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_the_archives_folder_opens_by_path_and_by_uri(tmp_path, form):
    (tmp_path / "a").write_bytes(b"here")
    system, base = filesystem(form.format(tmp_path))
    with system.open_input_file(f"{base}/a") as f:
        assert f.read() == b"here"
    assert op6_media.filesystem is filesystem


@pytest.mark.parametrize("name", sorted(p.stem for p in (Path(__file__).resolve().parents[2] / "heaplens" / "llm").glob("op*.py")))
def test_every_operator_can_be_imported(name):
    importlib.import_module(f"heaplens.llm.{name}")
