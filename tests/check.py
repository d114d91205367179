"""``python tests/check.py [folder] [name-part ...]``: compare every query with its SQL."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402
from trencher.session import local_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
parts = sys.argv[2:]
spark = local_session("check", "8")
con = connect(folder)
oracles = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    try:
        r = compare(spark, con, name, fn, oracles.get(name), folder)
    except Exception as exc:  # noqa: BLE001
        r = {"name": name, "ok": False, "why": f"{type(exc).__name__}: {str(exc)[:900]}"}
    bad += r["ok"] is False
    print({True: "ok  ", False: "FAIL", None: "rows"}[r["ok"]], name, r.get("rows"), f"{r.get('sec')}s", r.get("why", ""), flush=True)
print("failures:", bad)
