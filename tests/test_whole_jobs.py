"""Queries over whole tables: brute force, and rows that a cut would drop."""

import os

import numpy as np
import pandas as pd
import pytest

from loamstone.plans import catalogue, registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def records(data):
    rows = pd.read_parquet(os.path.join(data, "mem_records.parquet"))
    return rows[rows["id"].notna()].sort_values("arrived_at", kind="stable").drop_duplicates("id")


def test_neighbours_of_every_owner(spark, data, records):
    held = records[records["embedding"].notna()].sort_values("id")
    chosen = held[held["id"].str[-6:].map(lambda x: int(x, 16) % 100 == 0)]
    assert (chosen["owner_id"] != catalogue.CFG.owner).any()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit(np.array(chosen["embedding"].to_list(), dtype=float)) @ unit(np.array(held["embedding"].to_list(), dtype=float)).T, 9)
    want = {(q, k + 1, held["id"].iloc[i]) for q, row in zip(chosen["id"], scores) for k, i in enumerate(np.argsort(-row, kind="stable")[:20])}
    got = {(r["query_id"], r["leg_rank"], r["id"]) for r in QUERIES["record_neighbours"](spark, data).collect()}
    assert got == want


def test_times_of_every_record(spark, data, records):
    got = {r["id"]: r["saved"] for r in QUERIES["saved_times"](spark, data).collect()}
    assert set(got) == set(records["id"])
    odd = records[records["timestamp_epoch"].isna() | (records["timestamp_epoch"] >= 2.5e11)]["id"]
    assert len(odd) and all(got[i] == "unknown" for i in odd)
    assert sum(x == "unknown" for x in got.values()) == len(odd)


def test_rows_of_records_and_documents(spark, data, records):
    docs = pd.read_parquet(os.path.join(data, "doc_records.parquet"))["id"].dropna()
    got = [(r["id"], r["is_doc"]) for r in QUERIES["render_rows"](spark, data).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, False) for i in records["id"]} | {(i, True) for i in docs}


def test_block_of_every_search(spark, data):
    got = {r["query_id"]: r["size"] for r in QUERIES["render_blocks"](spark, data).collect()}
    assert set(got) == set(pd.read_parquet(os.path.join(data, "search_queries.parquet"))["query_id"])
    assert 0 < max(got.values()) <= catalogue.CFG.context_max_chars


def test_refresh_of_the_results_of_every_search(spark, data, records):
    found = [r for r in QUERIES["search_full"](spark, data).collect() if not r["weak"] and r["rank"] <= catalogue.CFG.ttl_refresh_top_k]
    got = {(r["id"], r["is_doc"]): r for r in QUERIES["ttl_refresh"](spark, data).collect()}
    found = [r for r in found if (r["id"], r["is_doc"]) in got]  # what has expired by then is gone
    until = catalogue.NOW + catalogue.CFG.ttl_seconds
    assert found and all(got[r["id"], r["is_doc"]]["expires_at"] == until for r in found)
    live = records[records["expires_at"].isna() | (records["expires_at"] > catalogue.NOW)]
    before = int(live["access_count"].fillna(0).sum())
    assert sum(r["access_count"] for (_, is_doc), r in got.items() if not is_doc) - before == len(found)
