"""URL filter: host and path rules, and logistic regression on hashed character n-grams where no rule fits.

DataFrame functions and spark.ml only. The n-grams of ``^host$`` and ``^path$`` are hashed into ``SIZE`` columns; the model
is fitted on a small table of labelled URLs: public hosts of either kind with some paths each. Rules are a short
fixed list and become one expression.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.htmltext import host_and_path
from threadmill.llm.tools import rename

#: Columns, sizes of n-grams, strength of the penalty, and the score from which a URL is blocked: chosen on hosts held out from the fit (``tests/llm/test_urlfilter.py``).
SIZE, GRAMS, REGULARIZED, BLOCKED = 1 << 18, (3, 4, 5), 0.08, 0.65
# Public hosts that a training corpus takes from, as they are known.
ORDINARY = """
    arduino.cc raspberrypi.com adafruit.com ableton.com kodak.com nikon.com canon.com sony.com panasonic.com samsung.com bosch.com lego.com ikea.com nestle.com unilever.com
    toyota.com honda.com ford.com bmw.com audi.com volvocars.com boeing.com airbus.com michelin.com dhl.com fedex.com ups.com maersk.com
    worldathletics.org olympics.com usatf.org runnersworld.com fieldmuseum.org figma.com canva.com autodesk.com blender.org gimp.org inkscape.org nvidia.com intel.com
    amd.com oracle.com salesforce.com dropbox.com zoom.us slack.com trello.com atlassian.com notion.so evernote.com cisco.com vmware.com siemens.com philips.com
    en.wikipedia.org github.com gitlab.com python.org numpy.org kernel.org gnu.org apache.org mozilla.org debian.org ubuntu.com w3.org ietf.org docs.oracle.com developer.apple.com
    learn.microsoft.com cloud.google.com aws.amazon.com ibm.com intel.com nature.com science.org pnas.org springer.com elsevier.com wiley.com plos.org acm.org ieee.org jstor.org
    mit.edu stanford.edu harvard.edu berkeley.edu princeton.edu ox.ac.uk cam.ac.uk ethz.ch uni-heidelberg.de tum.de sorbonne-universite.fr uam.es u-tokyo.ac.jp utoronto.ca
    nytimes.com washingtonpost.com theguardian.com reuters.com apnews.com economist.com cnn.com npr.org time.com theatlantic.com lemonde.fr lefigaro.fr spiegel.de zeit.de faz.net
    elpais.com elmundo.es corriere.it aljazeera.com dw.com nasa.gov noaa.gov nih.gov cdc.gov loc.gov archives.gov census.gov europa.eu who.int un.org worldbank.org gov.uk service.gov.uk
    bundestag.de service-public.fr britannica.com nationalgeographic.com smithsonianmag.com metmuseum.org louvre.fr britishmuseum.org gutenberg.org archive.org openlibrary.org goodreads.com
    imdb.com rottentomatoes.com allrecipes.com seriouseats.com bbcgoodfood.com tripadvisor.com lonelyplanet.com booking.com airbnb.com ikea.com rei.com target.com bestbuy.com etsy.com
    espn.com fifa.com olympics.com chess.com runnersworld.com weather.com accuweather.com mayoclinic.org webmd.com healthline.com khanacademy.org coursera.org duolingo.com quora.com
    medium.com wordpress.org blogger.com craigslist.org linkedin.com thesaurus.com dictionary.com investopedia.com bloomberg.com forbes.com nasdaq.com homedepot.com autotrader.com
    gardeningknowhow.com thespruce.com instructables.com hackaday.com arstechnica.com wired.com theverge.com techcrunch.com slashdot.org
""".split()
# Public hosts of gambling, pornography, pirated copies, pills, tracking and advertising, as they are known.
UNWANTED = """
    bet-at-home.com betfair.com betway.com betvictor.com bwin.com 10bet.com 22bet.com 1xbet.com mybookie.ag bovada.lv sportsbet.com.au unibet.com betonline.ag betsson.com pokerstars.com
    partypoker.com ggpoker.com 888poker.com 888casino.com casino.com leovegas.com casumo.com jackpotcity.com slotomania.com spincasino.com royalvegas.com playojo.com slotsempire.com
    casinoroom.com luckynuggetcasino.com freeslots.com jackpotjoy.com lotteryworld.com thelotter.com lottoland.com pornhub.com xvideos.com xnxx.com xhamster.com youporn.com redtube.com
    tube8.com spankbang.com youjizz.com chaturbate.com livejasmin.com stripchat.com cam4.com camsoda.com bongacams.com adultfriendfinder.com sexvideos.com freeporn.com hotsex.com
    xxxvideos.com adulttime.com eroprofile.com escortdirectory.com eros.com thepiratebay.org 1337x.to kickasstorrents.to limetorrents.info torrentz2.eu torrentdownloads.me rarbg.to
    yts.mx nulled.to crackserialkeys.com warez-bb.org serials.ws keygenguru.com doubleclick.net googlesyndication.com googleadservices.com adnxs.com adsrvr.org adroll.com ads-twitter.com
    advertising.com adform.net admob.com taboola.com outbrain.com criteo.com popads.net propellerads.com clickbank.net clickadu.com trafficjunky.com tracking-pixel.com scorecardresearch.com
    canadapharmacy.com buyviagraonline.com cheapmeds.com pillsonline.com onlinepharmacy.net genericviagra.com dietpills.com replicawatches.com payday-loans.com getrichquick.com freeprize.com
""".split()
# Words that hosts of either kind are often named after; ``FORMS`` makes hosts of them.
ORDINARY_WORDS = """
    news science library museum school university health research history travel garden recipes weather sports music books forum wiki docs government journal review archive photo
    family theatre college market hospital church football biology cooking maths alphabet airport railway nature energy kitchen teacher student village council bank insurance
""".split()
UNWANTED_WORDS = """
    casino poker slots jackpot bingo lottery betting bets gambling roulette blackjack porn xxx sex escort camgirls cams erotic hentai adult torrent warez cracked keygen serials
    viagra cialis pills pharmacy steroids adserver ads adclick banners popup tracker clicks payday loans forex spam replica prizes winner
""".split()
FORMS = ("{}.com", "best-{}.net", "{}online.org", "my{}.info")
#: Paths, by turns: the same for either kind, so that hosts decide, and for each kind two of its own.
PATHS = ("/", "/index.html", "/en/news/2021/05/story-1234.html", "/de/artikel/88", "/fr/page.php", "/es/4711/", "/about", "/en/1204")
ORDINARY_PATHS, UNWANTED_PATHS = ("/wiki/history_of_science", "/docs/library/reference.html"), ("/free-spins/casino-bonus", "/xxx/videos/click-here-win-prize")
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(host, path, label): the built-in table, label 1 for unwanted hosts. Every host stands with four paths, made ones with one, and half of them with a www. before them."""
    rows = []
    for label, hosts, own in ((0, ORDINARY, ORDINARY_PATHS), (1, UNWANTED, UNWANTED_PATHS)):
        for k, host in enumerate(hosts):
            paths = [PATHS[(3 * k + j) % len(PATHS)] for j in range(3)] + [own[k % len(own)]]
            rows += [(("www." if k % 2 else "") + host, p, label) for p in paths]
    for label, words in ((0, ORDINARY_WORDS), (1, UNWANTED_WORDS)):
        rows += [(("www." if k % 2 else "") + form.format(word), PATHS[(k + j) % len(PATHS)], label) for k, word in enumerate(words) for j, form in enumerate(FORMS)]
    values = ", ".join(f"('{h}', '{p}', {y}.0D)" for h, p, y in rows)
    return spark.sql(f"select * from values {values} as t(host, path, label)")


def grams(host: Column, path: Column) -> Column:
    """The n-grams of ^host$ and ^path$, marked h and p; of a shorter text the whole."""

    def of(text: Column, n: int, mark: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda at: F.concat(F.lit(mark), F.substring(text, at, F.lit(n))))

    texts = ((F.concat(F.lit("^"), host, F.lit("$")), "h"), (F.concat(F.lit("^"), path, F.lit("$")), "p"))
    return F.concat(*(of(text, n, mark) for text, mark in texts for n in GRAMS))


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """labelled(host, path, label); it is meant to be small, as it is read some dozens of times."""
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=SIZE, binary=True).transform(labelled.withColumn("grams", grams(F.col("host"), F.col("path"))))
    share = labelled.agg(F.avg("label")).first()[0]
    weighed = hashed.select("features", "label", F.when(F.col("label") > 0, 1 - share).otherwise(share).alias("weight"))
    held = weighed.coalesce(1).cache()
    model = LogisticRegression(regParam=REGULARIZED, maxIter=50, weightCol="weight").fit(held)
    held.unpersist()
    return model


def score(urls: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """urls(host, path) with score, the chance of being unwanted."""
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=SIZE, binary=True).transform(urls.withColumn("grams", grams(F.col("host"), F.col("path"))))
    return model.transform(hashed).withColumn("score", vector_to_array("probability")[1])


def rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host, or a domain above it, and the start of the path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(domain + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict (allow or block), score (of the model: the chance of block).

    A null url, or one without ``://``, has empty host and path and is judged by the model like any other. Null
    ids are carried along; repeated rows are judged alike; an empty table gives no rows. Only id and url are read.
    """
    model = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    named = rename(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    scored = score(named, model)
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= BLOCKED, "block").otherwise("allow")).alias("verdict"), "score")
