from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.session import local_session  # noqa: E402
from plumbline.store import AdvisoryStore  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session


def advisory(vid: str, name: str, events: list[dict], **more) -> dict:
    entry = {"package": {"ecosystem": "PyPI", "name": name}, "ranges": [{"type": more.pop("type", "ECOSYSTEM"), "events": events}]}
    entry.update(more.pop("entry", {}))
    return {"id": vid, "modified": "2024-01-01", "summary": f"issue in {name}", "affected": [entry], **more}


V3 = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"


def severity(vector: str = V3) -> list[dict]:
    return [{"type": "CVSS_V3", "score": vector}]


@pytest.fixture(scope="session")
def seed(tmp_path_factory) -> Path:
    """A small landed mirror with one advisory per case."""
    root = tmp_path_factory.mktemp("seed")
    osv = root / "osv"
    osv.mkdir()
    sym = lambda *s: {"database_specific": {"affected_functions": list(s)}}
    records = [
        advisory("ADV-1", "Yam_Lib", [{"introduced": "0"}, {"fixed": "5.4"}], aliases=["CVE-2020-1"], severity=severity(), entry=sym("yamlib.load_all")),
        advisory("ADV-2", "webby", [{"introduced": "1.0"}, {"last_affected": "1.5"}, {"introduced": "2.0"}, {"fixed": "2.3"}], aliases=["CVE-2020-2"], severity=severity(), entry=sym("webby.auth.rebuild_auth")),
        advisory("ADV-3", "tmpl", [{"introduced": "0"}, {"fixed": "3.1"}], severity=severity(), withdrawn="2024-02-02"),
        advisory("ADV-4", "tmpl", [{"introduced": "0"}, {"fixed": "3.0"}], aliases=["CVE-2020-4"], severity=severity()),
        advisory("ADV-5", "listed", [], entry={"versions": ["1.0", "1.1"]}),
        advisory("ADV-6", "gitty", [{"introduced": "0"}, {"fixed": "deadbeef-not-a-version"}], type="GIT"),
    ]
    (osv / "a.json").write_text(json.dumps(records[:3]))
    for r in records[3:]:
        (osv / f"{r['id']}.json").write_text(json.dumps(r))
    (osv / "broken.json").write_text("{not json")
    (root / "epss.csv").write_text("# note\ncve,epss,percentile\nCVE-2020-1,0.092,0.83\nCVE-2020-2,0.028,0.66\nCVE-2020-9,bad,0.1\nCVE-2020-4,0.047,0.74\n")
    (root / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "cve-2020-4", "dateAdded": "2024-03-03"}]}))
    return root


@pytest.fixture(scope="session")
def store(spark, seed, tmp_path_factory) -> AdvisoryStore:
    made = AdvisoryStore(spark, str(tmp_path_factory.mktemp("store") / "s"))
    made.sync(str(seed))
    return made


LOCK = """
[[package]]
name = "Yam_Lib"
version = "5.3"
files = [{file = "y", hash = "sha256:aa"}]

[[package]]
name = "webby"
version = "2.1"
[package.dependencies]
tmpl = "*"

[[package]]
name = "tmpl"
version = "2.9"

[[package]]
name = "idle"
version = "1.0"

[[package]]
name = "requestss"
version = "1.0"
"""


@pytest.fixture(scope="session")
def project(tmp_path_factory) -> Path:
    """A project with a lock file, first-party code and installed sources."""
    root = tmp_path_factory.mktemp("proj")
    (root / "poetry.lock").write_text(LOCK)
    (root / "pyproject.toml").write_text('[project]\ndependencies = ["yam-lib>=5", "webby", "requestss"]\n')
    app = root / "app"
    app.mkdir()
    (app / "__init__.py").write_text("")
    (app / "main.py").write_text(
        "import webby\nfrom app.config import read\n\n\ndef fetch():\n    get = webby.get\n    return get('x')\n\n\n"
        "def main():\n    read()\n    return fetch()\n\n\nif __name__ == '__main__':\n    main()\n"
    )
    (app / "config.py").write_text("from yam_lib import load_all\n\n\ndef read():\n    return load_all('x')\n")
    (app / "bad.py").write_text("def broken(:\n")
    site = root / ".venv" / "lib" / "python3.12" / "site-packages" / "webby"
    site.mkdir(parents=True)
    (site / "__init__.py").write_text("def get(u):\n    return send(u)\n\n\ndef send(u):\n    return Session().rebuild_auth(u)\n\n\ndef safe():\n    return 1\n")
    (site / "hooks.py").write_text("import os\nos.system('x')\n")
    return root
