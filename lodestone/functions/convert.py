"""Markup, schemas and messages to Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewrites of storage format, in order (fixed values).
TAG_REWRITES = [
    (r"<h1[^>]*>", "# "), (r"<h2[^>]*>", "## "), (r"<h3[^>]*>", "### "), (r"<h4[^>]*>", "#### "), (r"<h5[^>]*>", "##### "), (r"<h6[^>]*>", "###### "), (r"</h\d>", "\n"),
    (r"<p[^>]*>", ""), (r"</p>", "\n\n"), (r"<div[^>]*>", ""), (r"</div>", "\n"), (r"<br\s*/?>", "\n"), (r"<li[^>]*>", "- "), (r"</li>", "\n"),
    (r'(?s)<ac:structured-macro[^>]*ac:name="code"[^>]*>.*?</ac:structured-macro>', "```\n```"),
    (r"<pre[^>]*>", "```\n"), (r"</pre>", "\n```\n"), (r"<code[^>]*>", "`"), (r"</code>", "`"), (r"<blockquote[^>]*>", "> "), (r"</blockquote>", "\n"), (r"<hr\s*/?>", "\n---\n"),
    (r"<th[^>]*>", "| "), (r"</th>", " |"), (r"<td[^>]*>", "| "), (r"</td>", " |"), (r"<tr[^>]*>", ""), (r"</tr>", " |\n"),
    (r"<t(?:head|body|foot)[^>]*>|</t(?:head|body|foot)>", ""), (r"<table[^>]*>|</table>", "\n"), (r"<[^>]+>", ""),
]
#: Named entities, in order (fixed values).
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…")]


def _numeric_entities(text: Column) -> Column:
    """``&#65;`` and ``&#x41;`` as characters: only texts that have any are cut at them and put together again."""
    found = F.regexp_extract_all(text, F.lit(r"&#(\d{1,7}|x[0-9a-fA-F]{1,6});"), F.lit(1))
    between = F.split(text, r"&#(?:\d{1,7}|x[0-9a-fA-F]{1,6});", -1)

    def char(ref: Column) -> Column:
        code = F.when(ref.startswith("x"), F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("int")
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    pieces = F.transform(between, lambda part, i: F.concat(part, F.coalesce(char(F.get(found, i)), F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)


def storage_to_markdown(html: Column) -> Column:
    """Storage format or plain HTML as approximate Markdown."""
    out = html
    for pattern, to in TAG_REWRITES:
        out = F.regexp_replace(out, pattern, to)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(_numeric_entities(out), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"\A[\s\x{85}\x{A0}\x1C-\x1F\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+|[\s\x{85}\x{A0}\x1C-\x1F\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+\z", "")


def slack_message(user: Column, ts: Column, text: Column, attachments: Column) -> Column:
    """``**user** (time UTC)``, the text and attachments' texts, without blank lines. ``ts`` is an epoch string."""
    at = F.date_format(F.timestamp_seconds(ts.cast("double")), "yyyy-MM-dd HH:mm")
    head = F.concat(F.lit("**"), F.coalesce(user, F.lit("unknown")), F.lit("** ("), at, F.lit(" UTC)"))
    return F.array_join(F.filter(F.flatten(F.array(F.array(head, text), F.coalesce(attachments, F.array().cast("array<string>")))), lambda x: F.trim(x) != ""), "\n")


def column_type(data_type: Column, udt: Column, char_max: Column, precision: Column, scale: Column) -> Column:
    """``base(len)`` or ``base(p,s)``; a custom type's own name goes before the generic one."""
    custom = udt.isNotNull() & (udt != "") & (udt != data_type) & ~udt.startswith("_")
    base = F.when(custom, udt).otherwise(data_type)
    return F.when(char_max.isNotNull(), F.concat(base, F.lit("("), char_max, F.lit(")"))).when(precision.isNotNull() & (scale > 0), F.concat(base, F.lit("("), precision, F.lit(","), scale, F.lit(")"))).otherwise(base)


def shortened(value: Column, most: int = 60) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)
