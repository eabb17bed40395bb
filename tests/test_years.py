from driftline.plans import catalog, registry  # noqa: F401
from driftline.sources import analog

SF = "/root/testdata/sf0.001"


def test_yearly_files_hold_every_fix(spark):
    got = sorted(map(tuple, registry.QUERIES["src07_yearly_files"](spark, SF).collect()))
    want, last, n = [], None, 0
    for hex_, t, _, lat, lon in sorted((r["hex"], r["t_ms"], r["seq"], r["lat"], r["lon"]) for r in analog.fixes(spark, SF).collect()):
        n = n + 1 if hex_ == last else 0
        last = hex_
        want.append((hex_, n, lat, lon, t))
    assert got == want
