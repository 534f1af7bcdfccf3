"""Every registered query has an SQL twin; a selection runs against it here, all of them with FULL_CHECK=1."""

import os
import subprocess
import sys

import __spark_entry__ as entry
from inkprint.plans.registry import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
SELECTION = ["rank_eval", "link_eval", "linking_metrics", "min_dcf", "tfidf_linking", "assemble_without_heldout",
             "episode_random", "build_pairs", "ranked_list_score", "semihard_triplets", "action_vocab", "keep_comment",
             "scan_id_lists", "write_metrics"]


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries()) and len(QUERIES) > 100


def test_queries_equal_their_twins():
    names = sorted(QUERIES) if os.environ.get("FULL_CHECK") else SELECTION
    run = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "check_oracle.py"), DATA, *names],
                         capture_output=True, text=True, timeout=3000)
    assert run.returncode == 0, run.stdout[-3000:] + run.stderr[-500:]


def test_time_stamps_do_not_depend_on_the_session_zone(spark):
    found = []
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        found.append(sorted(map(tuple, entry.queries()["hour_of"](spark, DATA).collect())))
    spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1]


def test_plans_hold_no_pair_joins(spark):
    """No cross join or nested loop anywhere in the flagship and composed queries."""
    for name in ("rank_eval", "score_pairs", "link_eval", "build_pairs", "tfidf_linking", "assemble_history",
                 "episodes_per_author", "negative_pairs"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_missing_library_costs_only_its_queries():
    """Without a library of the training-data operators, all other queries are there."""
    code = ("import sys; sys.modules['zstandard'] = sys.modules['regex'] = sys.modules['tiktoken'] = None\n"
            "import warnings; warnings.simplefilter('ignore')\n"
            "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))")
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == [str(len(QUERIES)), "False"], run.stderr[-500:]
