"""What queries send through the driver: no ids of whole tables, however small Spark takes them for."""

import hashlib
import re

import pytest

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from evigraph import catalog, catalog_more
from evigraph.operators import pins

D = "/root/testdata/sf0.001"  # 1,690 nodes of the trade graph
LIMIT = 8192  # bytes that may be broadcast: of rows with one id, which take 24 bytes in a shuffle, 341
QUERIES = {**catalog.QUERIES, **catalog_more.QUERIES}

CHECKED = [
    "q_as_of",
    "q_check_broad",
    "q_check_empty",
    "q_check_high_water",
    "q_content_ids",
    "q_edge_ids",
    "q_kind_alternation",
    "q_kind_filter",
    "q_now_valid",
    "q_pred_eq",
    "q_pred_has",
    "q_pred_in",
    "q_intersect",
    "q_named_reference",
    "q_complement",
    "q_hop_forward",
    "q_hop_inverse",
    "q_hop_undirected",
    "q_multi_hop",
    "q_incidence",
    "q_closure",
    "q_pinned",
    "q_loaded_log",
    "q_drift",
]


def broadcast_rows(spark, run) -> list[int]:
    """The rows of each broadcast of all executions of ``run()``, those of written steps included."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    first = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    got, executions = [], store.executionsList()
    for k in range(first, executions.size()):
        n = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(n), store.planGraph(n).allNodes()
        for x in (nodes.apply(i) for i in range(nodes.size())):
            if x.name() == "BroadcastExchange":
                metrics = {m.name(): m.accumulatorId() for m in (x.metrics().apply(i) for i in range(x.metrics().size()))}
                said = values.get(metrics["number of output rows"])
                got.append(int(re.sub(r"\D", "", said.get())) if said.isDefined() else 0)
    return got


@pytest.fixture(scope="module")
def limited(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", LIMIT)
    catalog._trade.clear()
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    catalog._trade.clear()


@pytest.mark.parametrize("name", CHECKED)
def test_broadcasts_are_as_small_as_the_limit_says(limited, name):
    catalog._trade.clear()  # the load of the graph counts too
    rows = broadcast_rows(limited, lambda: QUERIES[name](limited, D).collect())
    assert max(rows, default=0) * 24 <= LIMIT


def test_drift_holds_no_answer(spark, monkeypatch):
    g = catalog.trade(spark, D)
    p = pins.pin(g, "action")
    whole = "\n".join([*p["nodes"], *p["unresolved"], *p["cites"]])
    assert p["count"] == 1500 and p["set_hash"] == "sha256:" + hashlib.sha256(whole.encode()).hexdigest()[:16]
    taken, collect = [], DataFrame.collect

    def counted(df):
        taken.append(len(rows := collect(df)))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    assert pins.drift(g, "action", p) == ["fresh"]
    assert max(taken, default=0) < 10


def test_drift_sees_a_changed_row_of_nodes_without_aliases(spark):
    g = catalog.trade(spark, D)
    p = pins.pin(g, "action sort value desc")
    assert not [x for x in p["nodes"] if x.endswith("@None")] and len(set(p["nodes"])) == 1500
    few = g.nodes.where("id = 'o-7'").withColumn("owner", F.lit("c-0"))
    other = pins.what_if(g, few, g.edges.where("src = 'o-7'"))
    assert pins.drift(other, "action sort value desc", p) == ["results-changed"]
    assert pins.difference(p, pins.pin(other, "action sort value desc"))["changed"] == ["o-7"]
