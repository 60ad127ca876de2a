"""What grows with the corpus stays off the driver."""

import random

from sinoflow.llm import simhash
from sinoflow.llm.common import Scratch


def test_op4_broadcasts_nothing(spark, monkeypatch):
    plans, save = [], Scratch.save

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", noted)
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (1, simhash.HOT):  # with points in place of pairs, and without
        df = simhash.near_duplicates(docs, hot=hot)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
