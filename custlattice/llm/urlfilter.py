"""URL filter: host and path rules, and logistic regression on hashed character n-grams of host and path for all other pages.

Everything is DataFrame or SQL functions; the regression is Spark's own, trained from a small labelled URL table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Own labelled URLs: what a crawl of texts should leave out, and ordinary sites.
BLOCKED = """
http://adult-videos.example/en/12 http://www.adult-chat.example/fr/7 https://xxx-adult.example/de/4.html https://sexcam-live.example/es/9
https://porn-tube.example/en/31 http://hot-xxx.example/x/gallery https://m.adult-dates.example/en/6?page=2 http://blog.adult-x-pics.example/en/44
http://casino-royal.example/de/15 https://www.online-casino.example/en/22/ http://poker-win.example/fr/7 https://big-win-slots.example/en/400
http://lucky-win.example/es/81 https://casino-bonus.example/en/5 http://blog.casino-tips.example/de/2 http://m.casino-winner.example/en/13.html
http://free-bets-now.example/en/3 https://sports-bets.example/fr/21 http://bets-online.example/en/70 https://best-bets.example/de/8#top
http://www.free-bet-odds.example/es/5 http://free-spins.example/en/66 http://blog.free-bets-tips.example/en/1 https://bets-free.example/en/90
http://cheap-meds.example/en/19 https://www.pills-online.example/de/6 http://cheap-viagra.example/en/2 https://diet-pills.example/fr/11
http://buy-cheap-pills.example/en/8 http://pharmacy-cheap.example/es/2 https://cheap-watches.example/en/37 http://m.cheap-loans.example/en/9
http://ads-server.example/en/14 https://track-ads.example/de/3 http://banner-ads.example/en/25 http://m.ads-click.example/fr/12
https://ad-track.example/en/77 http://popup-ads.example/es/3 https://ads-user-track.example/en/6/ http://click-track.example/de/18
http://spam-links.example/en/51 https://link-farm.example/fr/4 http://seo-spam.example/en/28 https://content-farm.example/de/91
http://www.article-farm.example/en/2 http://spam-mail.example/es/40 https://spam-farms.example/en/33 http://blog.farm-spam.example/en/12
https://free-prize.example/en/10 http://phish-bank.example/login-verify http://warez-crack.example/keygen https://torrent-crack.example/fr/6
""".split()
ALLOWED = """
http://thonder.example/en/12 https://www.tionary.example/fr/88.html http://blog.thewhole.example/de/31 https://m.ththere.example/en/900
https://shtion.example/es/17 http://ableness.example/en/455/ https://blog.handre.example/fr/3#top http://www.ingthe.example/de/72?page=2
http://than.example/en/1 https://ernded.example/en/2 http://theater.example/program http://m.tionand.example/es/81.html
https://news.example/politics/2020 http://daily-news.example/world/3 https://blog.example/garden/roses http://docs.example/manual/install
https://wiki.example/page/history http://library.example/books/42 https://museum.example/collection http://university.example/physics/course
https://school.example/math/lesson http://science-journal.example/article/9 https://weather.example/city/berlin http://recipes.example/soup
https://cooking.example/bread/rye http://travel-notes.example/alps https://history.example/rome http://poetry.example/sonnets/18
https://forum.example/thread/77 http://questions.example/answer/5 https://code.example/project/readme http://open-data.example/tables
https://city-council.example/minutes http://courts.example/ruling/11 https://parliament.example/bills/2021 http://health-service.example/advice
https://hospital.example/departments http://bird-watch.example/species https://astronomy.example/stars http://chess.example/games/100
https://music-school.example/piano http://film-review.example/2019 https://railway.example/timetable http://farmers-market.example/apples
https://translation.example/de-en http://dictionary.example/word/house https://letters.example/1899 http://archive.example/text/555
""".split()

#: (host and path, verdict): what the sample query applies.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SIZES = (3, 4, 5)
FEATURES = 1 << 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased: from the first :// to / ? # or the end. Path: from there to ? # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule's host stands for its subdomains too; of equally long rules the first in order of text wins."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they come from; `^` and `$` stand for the ends."""

    def of(text: Column, mark: str) -> list[Column]:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        return [
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (k - 1), F.lit(1))), lambda i, k=k: F.concat(F.lit(mark), F.substring(whole, i, k)))
            for k in SIZES
        ]

    return F.concat(*of(F.lower(host), "h:"), *of(F.lower(path), "p:"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of the lists above, as a table that needs no Python worker."""
    return spark.createDataFrame(pa.table({"url": BLOCKED + ALLOWED, "label": [1.0] * len(BLOCKED) + [0.0] * len(ALLOWED)}))


def fit(labelled: DataFrame) -> PipelineModel:
    """Regression weights from columns url and label (1: block). Null urls count as empty ones, rows without a label are left out."""
    rows = labelled.where("label is not null").select(ngrams(*host_and_path(F.col("url"))).alias("_grams"), "label").coalesce(1)
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    regression = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_block", regParam=0.01, maxIter=60)
    return Pipeline(stages=[hashing, regression]).fit(rows)


def judged(pages: DataFrame, model: PipelineModel, rules=RULES) -> DataFrame:
    """pages' other columns, with host, path, rule, verdict and score (probability of block).

    The verdict is the rule's if one fits, else block from a score of 0.5 on. Every row has one; repeated rows and extra columns stay.
    Columns of pages named host, path, rule, verdict or score are replaced.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    known = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = known.withColumns({"rule": rule, "verdict": verdict, "_grams": ngrams(F.col("host"), F.col("path"))})
    scored = model.transform(known).withColumn("score", vector_to_array("_probability")[1])
    by_score = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    scored = scored.withColumn("verdict", F.coalesce("verdict", by_score))
    return scored.drop("_grams", "_features", "_raw", "_probability", "_block")
