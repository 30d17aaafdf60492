"""Every query of the core against its SQL over the smallest catalogue."""

import pytest

from shutterlake.plans import library, registry
from tests.helpers import DATA, canonical, duck

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    ours = registry.QUERIES[name](spark, str(DATA)).toPandas()
    theirs = duck(DATA).execute(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() >= 0


def test_hamming_pairs_and_members_give_every_pair_of_files(spark):
    hashes = {r["file_id"]: r["phash"] & (2**64 - 1) for r in library.files(spark, str(DATA)).where("phash is not null").select("file_id", "phash").collect()}
    members = [tuple(r) for r in registry.QUERIES["hamming_members"](spark, str(DATA)).select("file_id", "representative").collect()]
    assert sorted(f for f, _ in members) == sorted(hashes) and len({r for _, r in members}) == len(set(hashes.values())) < len(hashes)
    held = {}
    for file, name in members:
        held.setdefault(name, []).append(file)
    got = {(min(x, y), max(x, y), 0) for group in held.values() for x in group for y in group if x < y}
    for a, b, apart in registry.QUERIES["hamming_pairs"](spark, str(DATA)).select("a", "b", "distance").collect():
        got |= {(min(x, y), max(x, y), apart) for x in held[a] for y in held[b]}
    near = {(x, y, (hashes[x] ^ hashes[y]).bit_count()) for x in hashes for y in hashes if x < y}
    assert got == {p for p in near if p[2] <= 15}
