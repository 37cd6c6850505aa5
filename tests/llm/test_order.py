import random

from pyspark.sql import functions as F

from custlattice.llm.order import led, numbered


def test_leaders_and_places_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice((0, 1, 1, 1, 2, rng.randrange(9))), i, rng.randrange(5)) for i in range(300)] + [(1, None, 2)]
    df = spark.createDataFrame(rows, "g int, v bigint, w bigint").repartition(6)
    saved = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "5", "61"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = led(df, "g", "v", [F.col("v").asc_nulls_last()], "led").collect()
            least = {g: min(v for h, v, _ in rows if h == g and v is not None) for g, _, _ in rows}
            assert sorted((r.g, r.v, r.of, r.leads) for r in got if r.v is not None) == sorted((g, v, least[g], v == least[g]) for g, v, _ in rows if v is not None)
            assert [(r.of, r.leads) for r in got if r.v is None] == [(least[1], False)]
            placed = numbered(df, ["g", F.col("v").asc_nulls_last()], "numbered", "w").orderBy("place").collect()
            order = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))
            assert [(r.g, r.v) for r in placed] == [r[:2] for r in order] and [r.place for r in placed] == list(range(len(rows)))
            assert [r.before for r in placed] == [sum(w for *_, w in order[:i]) for i in range(len(order))]
        assert led(df.limit(0), "g", "v", ["v"], "led").count() == 0 and numbered(df.limit(0), ["g"], "numbered").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", saved)
