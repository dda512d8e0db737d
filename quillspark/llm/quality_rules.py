"""Line-first quality rules as DataFrame expressions: no Python runs on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

# The blanks that part words, the symbols that are counted, and boilerplate phrases.
BLANKS = " \t\n\u000b\f\r"
SYMBOL = "[#*$%&|<>]"
MARKS = SYMBOL + "|!!"
SENTENCE_END = "[.!?:;…\"'”’»)\\]][ \\t-\\r]*$"
BOILERPLATE = (
    "accept all cookies", "cookie policy", "enable javascript", "javascript is disabled", "privacy policy", "terms of service", "terms of use",
    "skip to content", "sign in to continue", "subscribe to our newsletter", "share on facebook", "powered by wordpress", "lorem ipsum", "all rights reserved",
    "this work is licensed under", "released under the", "permission is hereby granted, free of charge",
    "alle cookies akzeptieren", "cookie-richtlinie", "javascript ist deaktiviert", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "nutzungsbedingungen",
    "zum inhalt springen", "newsletter abonnieren", "auf facebook teilen", "alle rechte vorbehalten",
    "accepter tous les cookies", "politique de cookies", "javascript est désactivé", "politique de confidentialité", "conditions d'utilisation", "conditions générales",
    "aller au contenu", "abonnez-vous à notre newsletter", "partager sur facebook", "tous droits réservés", "mentions légales",
    "aceptar todas las cookies", "política de cookies", "javascript está desactivado", "política de privacidad", "términos de uso", "condiciones de uso",
    "saltar al contenido", "suscríbete a nuestro boletín", "compartir en facebook", "todos los derechos reservados", "aviso legal",
)
MENU = "[|»›·•→]| [>/] "
LINK = "https?://|www\\."
WINDOW = 8


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    spaced = text
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows found twice or more, the first included.

    Windows are compared by a 64-bit hash; only texts with equal ones go on to compare 96 bits,
    sort them, and add up the stretches that repeated windows cover.
    """

    def covered(w: Column) -> Column:
        window = lambda i: F.slice(w, i, WINDOW)
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        keyed = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(window(i)).alias("a"), F.hash(window(i)).alias("b"), i.alias("at"))))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])
        near = lambda s, k: F.coalesce(same(F.get(s, k), F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(F.get(s, k), F.get(s, k + 1)), F.lit(False))
        places = let(keyed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: near(s, k)), lambda x: x["at"])))
        lengths = let(places, lambda p: F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))))
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)

    def counted(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(covered(w))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(counted(w)))


def line_passes(line: Column) -> Column:
    """Punctuation: a line of under 4 words must end a sentence.  Navigation: symbols or doubled
    exclamation marks on over 3 in 10 words; or a menu, two or more separators between items of at most
    three words on average; or links on over a third of the words.  Boilerplate: a phrase of the list,
    in any of four languages, in a line of at most 30 words."""

    def passes(n: Column) -> Column:
        menus = F.regexp_count(line, F.lit(MENU))
        links = lambda x: F.when(F.contains(x, F.lit("://")) | F.contains(x, F.lit("www.")), F.regexp_count(x, F.lit(LINK))).otherwise(0)
        phrase = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in BOILERPLATE])
        marks = F.regexp_count(line, F.lit(MARKS)) * 10 <= n * 3
        return marks & ((n >= 4) | line.rlike(SENTENCE_END)) & ~((menus >= 2) & (n <= (menus + 1) * 4)) & let(F.lower(line), lambda x: (links(x) * 3 <= n) & ((n > 30) | ~phrase(x)))

    return let(F.size(F.split(F.btrim(line, F.lit(BLANKS)), " ")), passes)


def quality_rules(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text.

    Each line with a word is judged by ``line_passes``; clean_text holds the lines that pass and the
    blank ones.  kept is false if base_failed, or if over ``max_lost`` of the characters in lines with
    a word went.  A null or empty text has no words and fails the base; rows are judged one by one, so
    repeated rows, ties and null ids need no rule; an empty table gives no rows.  Columns of these
    names in the input are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: line.rlike("[^ \\t-\\r]")
    facts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    judged = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), has_word(x).alias("full"), (~has_word(x) | line_passes(x)).alias("stays")))
    lines = let(
        judged,
        lambda all_lines: let(
            F.transform(F.filter(all_lines, lambda x: x["full"]), lambda x: x["line"]),
            lambda full: F.struct(
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                F.length(F.array_join(full, "")).alias("before"),
                F.length(F.array_join(F.transform(F.filter(all_lines, lambda x: x["full"] & x["stays"]), lambda x: x["line"]), "")).alias("after"),
                F.array_join(F.transform(F.filter(all_lines, lambda x: x["stays"]), lambda x: x["line"]), "\n").alias("clean_text"),
            ),
        ),
    )
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    name = unused([*docs.columns, *added])
    fact, line = (lambda c: F.col(f"{name('facts')}.{c}")), (lambda c: F.col(f"{name('lines')}.{c}"))
    first = docs.select(*rest, facts.alias(name("facts")), lines.alias(name("lines")), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    base_failed = (fact("n_words") < 20) | (fact("n_repeat_words") * 100 > fact("n_words") * 30)
    kept = ~base_failed & (line("before") - line("after") <= line("before") * F.lit(max_lost))
    return first.select(*rest, fact("n_words"), fact("word_chars"), "n_symbols", line("n_dup_lines"), fact("n_repeat_words"), base_failed.alias("base_failed"), kept.alias("kept"), line("clean_text"))
