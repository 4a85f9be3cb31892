"""URL verdicts: rules of hosts and path beginnings, and a logistic regression for the rest.

The regression reads hashed runs of 3 to 5 bytes of the host and of the path, each with marks at its ends, present
or not, and is trained from a small labelled URL table; ``Settings.max_labelled`` bounds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, Words

UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
GRAM_BYTES = (3, 4, 5)
#: No byte ends a run: blanks inside a URL are part of it.
_TABLE = bytes(0x5F if b in (0x20, 9, 10, 11, 12, 13) else LOWER[b] for b in range(256))

#: The labelled table that the query trains from: what such lists commonly refuse, and ordinary sites. It names no host
#: of the given tables.
BLOCKED = (
    "royal-casino.biz/play", "www.casinoslots.info/bonus/7", "casino-bonus.example/spins", "poker-jackpot.org/join",
    "winbig-lottery.com/en", "easy-win.biz/claim", "win-prizes.info/now", "sportsbetting.net/odds/3", "bets-today.info/live",
    "betting-odds.biz/tips", "free-spins.biz/offer", "freeringtones.info/get", "free-coupons.biz/x", "spam-mailer.info/send",
    "bulkspam.net/mail", "link-farm.biz/page/7", "content-farm.info/a/12", "seofarm.net/links", "click-farm.org/likes",
    "adult-dating.biz/meet", "www.adultvideos.net/watch", "xxx-cams.info/live", "adult-chat.org/room/3", "x-rated.biz/clip",
    "discount-pills.biz/buy", "diet-pills.org/order", "pills-online.info/cart", "cheap-meds.info/order", "cheapwatches.biz/sale",
    "cheap-replica.net/bags", "ads-server.net/pixel", "ads.banner-farm.biz/b.js", "popup-ads.info/show", "click-tracker.biz/r",
    "usertrack.info/px", "track-visitors.net/beacon", "m.online-casino.org/en/70", "www.casino-night.net/fr/8.html",
    "blog.free-money.org/de/6", "www.bets-club.com/es/31", "m.ads-pool.com/en/44", "www.ad-tracking.org/fr/3/",
    "blog.spam-king.com/de/22", "m.adult-zone.org/es/7.html", "www.pills-market.com/en/5", "blog.win-money.com/en/4",
    "m.free-games-casino.net/fr/2.html", "www.bets-arena.org/en/810",
)
ALLOWED = (
    "library.uni-city.edu/catalog", "www.weather-service.org/today", "docs.opensource.dev/guide/2", "news-daily.com/world/12",
    "museum.org/en/visit", "city-council.gov/fr/plan", "blog.gardening.net/2019/roses", "recipes.home.org/soup",
    "www.railway.co/timetable", "shop.bookstore.com/cart", "farmers-market.org/stalls", "adult-education.edu/courses",
    "pharmacy-school.edu/admissions", "trackandfield.org/results", "wildlife.park.net/birds", "maps.region.info/de/5",
    "forum.linux.org/t/99", "wiki.history.net/page", "radio.station.fm/live", "bank.local.com/login", "hospital.org/contact",
    "chess.club.net/games/4", "freedom-press.org/story", "winter-sports.net/ski", "betterhomes.com/ideas", "cheapside-parish.org/en",
    "alphabet-school.edu/reader", "bookstores.net/pages/31", "people.university.edu/~kim", "archive.newspaper.com/1999/03",
    "www.orchestra.org/tickets", "translate.dictionary.net/fr/word", "photos.travel.net/es/7.html", "m.cinema.com/de/22",
    "data.statistics.gov/en/table", "code.project.dev/issues/8", "www.mountain-hiking.com/en/12", "m.local-theatre.org/de/9/",
    "blog.baking-bread.net/fr/15", "www.city-orchestra.org/es/12", "m.bus-times.com/en/6", "blog.old-maps.org/en/55",
    "m.online-courses.org/en/70", "www.museum-night.net/fr/8.html", "blog.free-software.org/de/6", "www.rowing-club.com/es/31",
    "m.swimming-pool.com/en/44", "www.parcel-tracking.org/fr/3/", "blog.king-penguins.com/de/22", "m.play-zone.org/es/7.html",
    "www.antiques-market.com/en/5", "blog.pocket-money.com/en/4", "m.board-games.net/fr/2.html", "www.ice-arena.org/en/810",
)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_labelled: int = 50_000
    steps: int = 300
    rate: float = 0.3
    decay: float = 1e-3
    threshold: float = 0.5


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains where the url's path starts with the path."""

    verdict: str
    text: str

    def column(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        fits = (host == name) | F.endswith(host, F.lit("." + name))
        return fits & F.startswith(path, F.lit("/" + rest))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` up to ``/ ? #``, A-Z lower-cased, the path up to ``? #``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, PARTS, 1), UPPER_LETTERS, LOWER_LETTERS)
    return host, F.regexp_extract(text, PARTS, 2)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else null; of equal ones the first given."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):  # later ones override
        fits = rule.column(host, path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def grams(host: pa.Array, path: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the runs present in host and path, each pair once, by row."""
    keys = []
    for part, (values, mark) in enumerate(((host, "^"), (path, ">"))):
        framed = pc.binary_join_element_wise(mark, values.cast(pa.string()), "$", "")
        words = Words(framed, _TABLE)
        for size in GRAM_BYTES:
            hashes, at = words.grams(size)
            bucket = ((hashes * np.uint64(2 * part + 1)) >> np.uint64(64 - bits)).astype(np.int64)
            keys.append((np.searchsorted(words.offsets, at, "right") - 1) << bits | bucket)
    pairs = np.unique(np.concatenate(keys))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def train(rows: np.ndarray, buckets: np.ndarray, target: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """(bias, weights) by gradient steps with momentum; each row's runs weigh one over the root of their number."""
    n = len(target)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))
    balance = np.where(target == 1, n / max(1, 2 * target.sum()), n / max(1, 2 * (n - target.sum()))) / n
    bias, weights, size = 0.0, np.zeros(1 << s.bits), 1 << s.bits
    speed, speed_bias = np.zeros(size), 0.0
    for _ in range(s.steps):
        margin = bias + scale * np.bincount(rows, weights[buckets], n)
        error = (1 / (1 + np.exp(-margin)) - target) * balance
        grad = np.bincount(buckets, (error * scale)[rows], size) + s.decay * weights
        speed = 0.9 * speed - s.rate * grad
        speed_bias = 0.9 * speed_bias - s.rate * error.sum()
        weights, bias = weights + speed, bias + speed_bias
    return bias, weights


def fit(labelled: DataFrame, settings: Settings | None = None) -> tuple[float, np.ndarray]:
    """A model from ``labelled`` (``url``, ``label``: 1 to block); refuses more than ``max_labelled`` rows."""
    s = settings or Settings()
    host, path = split_url(F.col("url"))
    known = labelled.where(F.col("label").isin(0, 1)).select(host.alias("host"), path.alias("path"), "label")
    table = known.orderBy("host", "path", "label").limit(s.max_labelled + 1).toArrow()
    if len(table) > s.max_labelled:
        raise ValueError(f"more than {s.max_labelled} labelled urls: pass a sample")
    if not len(table):
        return 0.0, np.zeros(1 << s.bits)
    rows, buckets = grams(table.column("host").combine_chunks(), table.column("path").combine_chunks(), s.bits)
    return train(rows, buckets, table.column("label").to_numpy().astype(float), s)


def judge(pages: DataFrame, rules: Sequence[Rule], model, settings: Settings | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages`` (``page_id``, ``url``).

    The verdict is the longest fitting rule's, else ``block`` when the model's probability reaches the threshold.
    A null url, or one without ``://``, has an empty host and path and is scored as such. Null ids stay null,
    repeated rows are judged each, other columns are ignored, an empty table gives no rows.
    """
    s = settings or Settings()
    bias, weights = model
    used = np.flatnonzero(weights)
    values = weights[used]
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))

    def run(batches):
        full = np.zeros(1 << s.bits)
        full[used] = values
        for batch in batches:
            if not len(batch):
                continue
            row, bucket = grams(batch.column("host"), batch.column("path"), s.bits)
            n = len(batch)
            total = np.bincount(row, full[bucket], n) / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
            score = pa.array(1 / (1 + np.exp(-(bias + total))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    scored = rows.mapInArrow(run, StructType([*rows.schema, StructField("score", DoubleType())]))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("score") >= s.threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score"
    )


def labelled_urls(spark) -> DataFrame:
    """The labelled table of this module."""
    rows = [(f"https://{u}", 1) for u in BLOCKED] + [(f"http://{u}", 0) for u in ALLOWED]
    return spark.createDataFrame(rows, "url string, label int")
