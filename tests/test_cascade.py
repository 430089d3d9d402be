"""The decision cascade against a plain loop written from the text of
FLT-8 / WIN-1: sources in run order, postings in order, a posting is a
duplicate iff its hash is stored or an earlier *accepted* posting had it."""

import hashlib
import re

from pyspark.sql import functions as F

from gleaner import fixtures as fx
from gleaner.functions import roles as R
from gleaner.operators.decide import FilterConfig
from gleaner.plans import collection as C


def _role(t):
    for p, r in R.ROLE_RULES:
        if re.search(p, t.lower()):
            return r
    return None


def _loop(rows, stored, cfg):
    inserted = set(stored)
    out = {}
    for r in rows:
        role = _role(r["title"])
        if cfg.roles and (role is None or role not in cfg.roles):
            out[r["ord"]] = "role"
            continue
        if cfg.blocked and any(k in r["title"].lower() for k in cfg.blocked):
            out[r["ord"]] = "blocked_title"
            continue
        h = hashlib.sha256(r["url"].strip().encode()).hexdigest()
        if h in inserted:
            out[r["ord"]] = "duplicate"
            continue
        loc = r["location"]
        if cfg.locations and loc and not any(k in loc.lower() for k in cfg.locations):
            out[r["ord"]] = "location"
            continue
        deps = r["departments"] or []
        if cfg.departments and deps and not any(k in d.lower() for k in cfg.departments for d in deps):
            out[r["ord"]] = "department"
            continue
        inserted.add(h)
        out[r["ord"]] = "added"
    return out


def test_cascade_equals_loop(spark, sf_small):
    for cfg_d in (fx.CONFIG_A, fx.CONFIG_B):
        cfg = FilterConfig.from_dict(cfg_d)
        postings = fx.postings_df(spark, sf_small)
        stored = fx.stored_df(postings)
        decided, results = C.collection_run(fx.sources_df(spark, sf_small), postings, stored, cfg)
        got = {r["ord"]: r["step"] for r in decided.select("ord", "step").collect()}
        ok_sources = {r["source_id"] for r in results.where("status = 'success'").collect()}
        rows = [r.asDict() for r in postings.where(F.col("source_id").isin(list(ok_sources)))
                .orderBy("source_id", "ord").collect()]
        expect = _loop(rows, {r[0] for r in stored.collect()}, cfg)
        assert got == expect


def test_counters_add_up_and_rerun_adds_nothing(spark, sf_small):
    cfg = FilterConfig.from_dict(fx.CONFIG_A)
    postings = fx.postings_df(spark, sf_small)
    stored = fx.stored_df(postings)
    sources = fx.sources_df(spark, sf_small)
    decided, results = C.collection_run(sources, postings, stored, cfg)
    for r in results.where("status = 'success'").collect():
        assert r["jobs_found"] == r["jobs_added"] + r["jobs_filtered"] + r["jobs_skipped"]
    added = decided.where("step = 'added'").select("url_hash")
    _, again = C.collection_run(sources, postings, stored.unionByName(added), cfg)
    assert again.agg(F.sum("jobs_added")).first()[0] == 0


def test_dry_run_total_row(spark, sf_small):
    cfg = FilterConfig.from_dict(fx.CONFIG_A)
    from gleaner.sources.sources import sources_all
    _, counters = C.dry_run(sources_all(fx.sources_df(spark, sf_small)), fx.postings_df(spark, sf_small), cfg)
    rows = counters.collect()
    total = [r for r in rows if r["company"] == "TOTAL"][0]
    per = [r for r in rows if r["company"] != "TOTAL"]
    for k in ("found", "would_add", "filtered", "blocked"):
        assert total[k] == sum(r[k] for r in per)
