"""Fill-in-middle by escaped marker injection, in SQL functions only.

A text is escaped so that a delimiter cannot occur in it, ``regexp_replace`` appends the delimiter after each
unit, the delimiters are counted, ``substring_index`` takes the units up to a rank, and the parts are freed of delimiters
and escapes and put together around sentinels. A row is worked on where it lies: nothing is shuffled, and a hot source or
a long text costs its own length only.

Two hashes of the id choose where prefix and middle end, two more the form: ``plain`` (text as it stands), ``psm`` (prefix, suffix,
middle) or ``spm`` (suffix, prefix, middle). A text that holds a sentinel stays plain, so ``restore`` gives every text back.

Null text: empty; an empty text is plain with no units. A null id hashes as the empty text, equal ids get equal hashes (so equal rows
equal results). An empty table stays empty. Input columns named like a result column are replaced; other names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")
SENTINELS = ("<P>", "<S>", "<M>")
#: Stands after each unit; does not occur in an escaped text.
DELIMITER = "\x01"
#: Starts an escape of two characters: ESCAPE + "e" is ESCAPE, ESCAPE + "d" is DELIMITER.
ESCAPE = "\x02"
#: One unit in an escaped text; together the matches cover the whole of it.
UNITS = {
    "code_point": f"(?s)[^{ESCAPE}]|{ESCAPE}.",
    "word": r"\s*\S+|\s+",
    "line": r"[^\n]*\n|[^\n]+",
}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``, for whole escapes, after delimiters are taken out."""
    plain = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def hash_parts(key: Column) -> list[Column]:
    """The first four groups of eight hex digits of a sha256, as unsigned integers."""
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str = "code_point",
    fim_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """``docs`` with units, form, characters of prefix and middle (null if plain) and the text put together.

    ``fim_percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first.
    """
    name = "fim"  # that no column has
    while name in docs.columns:
        name += "_"
    own = [c for c in docs.columns if c not in RESULT]
    c = lambda x: F.col(name)[x]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")))
    h1, h2, h3, h4 = hash_parts(key)
    held = [F.contains(text, F.lit(s)) for s in sentinels]
    plain = (text == "") | held[0] | held[1] | held[2] | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    safe = escaped(text)
    marked = F.regexp_replace(safe, UNITS[unit], "$0" + DELIMITER)
    # each struct reads what is dear from the one before, so that no text is marked or cut twice
    rows = docs.select(*[docs[x] for x in own], F.struct(text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"), marked.alias("marked"), F.length(safe).alias("unmarked")).alias(name))
    n = (F.length(c("marked")) - c("unmarked")).cast("long")
    rows = rows.withColumn(name, F.struct(c("text").alias("text"), c("form").alias("form"), c("h1").alias("h1"), c("h2").alias("h2"), c("marked").alias("marked"), n.alias("n")))
    a, b = c("h1") % (c("n") + 1), c("h2") % (c("n") + 1)
    up_to = lambda k: F.call_function("substring_index", c("marked"), F.lit(DELIMITER), k.cast("int"))
    cut = c("form") != "plain"
    # every unit has its delimiter, so behind the last of n - k more of them nothing stands
    behind = F.call_function("substring_index", c("marked"), F.lit(DELIMITER), -(c("n") - F.greatest(a, b) + 1).cast("int"))
    rows = rows.withColumn(
        name,
        F.struct(
            c("text").alias("text"), c("form").alias("form"), c("n").alias("n"), F.when(cut, unescaped(up_to(F.least(a, b)))).alias("prefix"),
            F.when(cut, unescaped(behind)).alias("suffix"),
        ),
    )
    first, last = F.length(c("prefix")).cast("long"), F.length(c("suffix")).cast("long")
    middle = F.substring(c("text"), first.cast("int") + 1, (F.length(c("text")) - first - last).cast("int"))
    rows = rows.withColumn(name, F.struct(c("text").alias("text"), c("form").alias("form"), c("n").alias("n"), c("prefix").alias("prefix"), middle.alias("middle"), c("suffix").alias("suffix")))
    p, s, m = (F.lit(x) for x in sentinels)
    whole = (
        F.when(c("form") == "psm", F.concat(p, c("prefix"), s, c("suffix"), m, c("middle")))
        .when(c("form") == "spm", F.concat(s, c("suffix"), p, c("prefix"), m, c("middle"))).otherwise(c("text"))
    )
    chars = lambda x: F.length(c(x)).cast("long")
    found = (c("n"), c("form"), chars("prefix"), F.when(c("form") != "plain", chars("middle")), whole)
    return rows.select(*own, *[x.alias(k) for k, x in zip(RESULT, found, strict=True)])


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` rearranged. Sentinels that no text holds occur once each, as none begins
    with what another ends with."""
    p, s, m = sentinels
    after = lambda x, mark: F.substring_index(x, mark, -1)
    before = lambda x, mark: F.substring_index(x, mark, 1)
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
