"""Spelling variants by anagram hashing: words one letter apart, the form each goes back to, and its root.

A word's key is the sum of its letters' fifth powers, so anagrams share a key, and one letter more, less or exchanged moves
it by that letter's power or by the difference of two. Keys that are moved by an exchange meet in the integer that is left
when a letter's power is taken from each; a key moved by an addition is left when the letter is taken from the longer one.
Keys that meet nobody are out, whatever words they have. Of the rest the order of letters is verified: what is left of both
words has to be equal, with the letter gone from the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import written
from tarn.llm.crc_sql import crc32_sql

#: Letters of a word, and how often it has to occur in the corpus, at least.
LETTERS, TIMES = 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def letter_value(letter: Column) -> Column:
    """The fifth power of a Latin-1 letter's number; 40 bits of a hash of any other character."""
    number = F.ascii(letter).cast("long")
    return F.when(number <= 255, number * number * number * number * number).otherwise(F.pmod(F.xxhash64(letter), F.lit(1 << 40)))


def near_words(words: DataFrame) -> DataFrame:
    """Every two words that differ by one inserted, deleted or replaced letter, in both directions: word, near, near_n.

    words (word, n): each word once; null words have no near ones. Pass a written table: it is read several times. Each
    pair comes once in each direction. Words have up to a million letters; of words whose keys meet a row is made for each
    place of the letter in question, whatever number of words share a key: no two words are compared that aren't near,
    but for collisions of 64-bit hashes, which the comparison of the words themselves sorts out.
    """
    letters = F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))
    keyed = written(words.where("word is not null").select("word", "n", letters.alias("letters")).withColumn("key", F.aggregate("letters", F.lit(0).cast("long"), lambda sum_, c: sum_ + letter_value(c))), "keyed")
    # Anagrams meet here already: what follows is of distinct keys and the letters in them.
    taken = keyed.select("key", F.explode(F.array_distinct("letters")).alias("letter")).distinct().withColumn("rest_key", F.col("key") - letter_value(F.col("letter")))
    taken = written(taken, "taken")
    keys = keyed.select(F.col("key").alias("rest_key"), "key").unionByName(taken.select("rest_key", "key"))
    meeting = written(keys.groupBy("rest_key").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("rest_key"), "meeting")
    live = written(taken.join(meeting, "rest_key", "left_semi"), "live")
    places = F.filter(F.sequence(F.lit(0), F.size("letters") - 1), lambda i: F.get(F.col("letters"), i) == F.col("letter"))
    out = keyed.join(live, "key").select("rest_key", "word", "n", "letters", "letter", F.explode(places).alias("place"))
    rest = F.concat(F.expr("left(word, place)"), F.expr("substring(word, place + 2)"))
    again = (F.col("place") > 0) & (F.get("letters", F.col("place") - 1) == F.col("letter"))
    out = written(out.select("rest_key", "place", F.xxhash64(rest).alias("rest"), "word", "n", again.alias("again")), "letter-out")

    other = out.select("rest_key", "place", "rest", F.col("word").alias("near"), F.col("n").alias("near_n"))
    same = (F.expr("left(word, place)") == F.expr("left(near, place)")) & (F.expr("substring(word, place + 2)") == F.expr("substring(near, place + 2)"))
    replaced = out.join(other, ["rest_key", "place", "rest"]).where((F.col("word") != F.col("near")) & same).select("word", "near", "near_n")
    # Of equal letters in a row any one leaves the same: the first stands for them.
    shorter = keyed.select(F.col("key").alias("rest_key"), F.xxhash64("word").alias("rest"), F.col("word").alias("short"), F.col("n").alias("short_n"))
    removed = out.where("not again").join(shorter, ["rest_key", "rest"]).where(F.col("short") == rest)
    moves = F.explode(F.array(F.struct("word", F.col("short").alias("near"), F.col("short_n").alias("near_n")), F.struct(F.col("short").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return replaced.unionByName(removed.select(moves.alias("m")).select("m.*"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word of forms (word, form) that has one: where its forms lead in the end.

    A form occurs more often than its word by a factor, so chains have no cycle and are as long as a logarithm of the
    largest count; each round of joins doubles the steps taken.
    """
    now = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_forms(words: DataFrame, factor: int = 2) -> DataFrame:
    """Each word with its form and root: word, form, root, n, n_near, form_n.

    words (word, n): a word that is given several times counts as one with the sum; null words are left out. A word's form
    is its near word of largest n, of several the first in code-point order, if that n is ``factor`` times the word's own
    or more; without one form and form_n are null, and its root is the word itself. No words give no rows. Further columns
    play no part.
    """
    words = written(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(written(best, "best"), "word", "left")
    holds = -F.col("best.less") >= factor * F.col("n")
    judged = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")), "forms")
    return judged.join(roots(judged), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def planted_words(docs: DataFrame) -> DataFrame:
    """The runs of letters of all documents in lower case, a row each; one in 97, by a hash of document and run, lacks a letter."""
    # A shorter run is no word, with or without a letter less.
    runs = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}"), F.lit(0)))
    runs = docs.select("doc_id", runs.alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    crc = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    return runs.withColumn("crc", crc).select(F.expr("CASE WHEN crc % 97 = 0 THEN concat(left(run, cast(crc % char_length(run) AS int)), substring(run, cast(crc % char_length(run) AS int) + 2)) ELSE run END").alias("word"))


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of five letters or more that occur three times or more in all documents, with their near words, forms and roots."""
    words = planted_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counted = words.where(F.char_length("word") >= LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIMES)
    return spelling_forms(counted)


OP11_SQL = f"""
WITH RECURSIVE u AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k FROM u GROUP BY ALL),
h AS (SELECT run, k, {crc32_sql("(doc_id || ':' || run)")} AS h FROM c),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
o AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM o),
l AS (SELECT DISTINCT a.word AS word, b.word AS near, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON rest = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON rest = w.word),
f AS MATERIALIZED (SELECT word, n, coalesce(k, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM w LEFT JOIN (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS k FROM l QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(near)) = 1) USING (word)),
r(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM r GROUP BY word) USING (word)
"""
