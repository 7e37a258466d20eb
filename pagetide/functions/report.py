"""Feedback reports: building, checking, formatting, and the policies of where they may go. Columns alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.text import clipped, document_name, image_bytes, one_of, trim

#: Limits and categories of reports.
CATEGORIES = ("equation", "selection", "playback", "interface", "other")
MOST_DESCRIPTION, MOST_EXCERPT, MOST_IMAGE_BYTES, MOST_TITLE = 1500, 2500, 8 << 20, 90
DIAGNOSTICS = ("extension_version", "browser", "page_number", "reading_position", "reading_items", "equation_count", "unresolved_count", "document_name")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def cut_text(c: Column, most: int) -> Column:
    """Trimmed and cut hard."""
    return F.left(trim(_text(c)), F.lit(most))


def safe_code_block(c: Column) -> Column:
    """Breaks up what would end a code block."""
    return F.replace(_text(c), F.lit("```"), F.lit("``\u200b`"))


def build_report(description: Column, category: Column, locale: Column, report_id: Column, created_at: Column, version: Column, browser: Column, page: Column, index: Column, items: Column, equations: Column, unresolved: Column, url: Column, excerpt: Column, with_excerpt: Column, image: Column, with_image: Column) -> Column:
    """The versioned report as a struct; null where the description is blank or the image too large. Excerpt and image only with consent."""
    told = clipped(description, MOST_DESCRIPTION)
    shown = F.when(F.coalesce(with_image, F.lit(False)) & (_text(image) != ""), image)
    diagnostics = (F.coalesce(version, F.lit("unknown")), clipped(browser, 300), page, index + 1, items, equations, unresolved, document_name(url))
    report = F.struct(
        F.lit(1).alias("schema_version"), one_of(locale, ("en",), "fr").alias("locale"), report_id.alias("report_id"), created_at.alias("created_at"), one_of(category, CATEGORIES, "other").alias("category"), told.alias("description"),
        F.struct(*(c.alias(n) for c, n in zip(diagnostics, DIAGNOSTICS))).alias("diagnostics"),
        F.when(F.coalesce(with_excerpt, F.lit(False)), clipped(excerpt, MOST_EXCERPT)).alias("selection_excerpt"), shown.alias("page_image"),
    )
    return F.when((told != "") & (F.coalesce(image_bytes(shown), F.lit(0)) <= MOST_IMAGE_BYTES), report)


def format_report(r: Column, words: dict[str, str]) -> Column:
    """The report in Markdown. words: the texts of one language by key."""
    d = r["diagnostics"]
    or_unknown = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(words["unknown"]))
    line = lambda key, *parts: F.concat(F.lit(f"- {words[key]}: "), *parts)
    head, _, tail = words["feedbackTitle"].partition("{category}")
    lines = [
        F.concat(F.lit(f"# {head}"), r["category"], F.lit(tail)), F.lit(""), r["description"], F.lit(""), F.lit(f"## {words['diagnostics']}"),
        line("version", or_unknown(d["extension_version"])), line("pdfPage", or_unknown(d["page_number"])), line("position", or_unknown(d["reading_position"]), F.lit(" / "), or_unknown(d["reading_items"])),
        line("equations", or_unknown(d["equation_count"]), F.lit(" ("), or_unknown(d["unresolved_count"]), F.lit(f" {words['unresolved']})")),
        line("document", F.coalesce(F.nullif(d["document_name"], F.lit("")), F.lit(words["notProvided"]))), line("browser", or_unknown(d["browser"])),
    ]
    excerpt = F.when(_text(r["selection_excerpt"]) != "", F.array(F.lit(""), F.lit(f"## {words['selectedExcerpt']}"), r["selection_excerpt"])).otherwise(F.array().cast("array<string>"))
    image = F.concat(F.lit(f"{words['pageImageAttached']}: "), F.when(r["page_image"].isNotNull(), words["yes"]).otherwise(words["no"]))
    return F.array_join(F.concat(F.array(*lines), excerpt, F.array(F.lit(""), image)), "\n")


def issue_body(r: Column, image_url: Column) -> Column:
    """The relay's issue text."""
    d = r["diagnostics"]
    known = lambda c, other="unknown": F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(other))
    bold = lambda name, *parts: F.concat(F.lit(f"**{name}:** "), *parts)
    lines = [
        bold("Report ID", F.lit("`"), r["report_id"], F.lit("`")), bold("Created", known(r["created_at"])), bold("Extension", known(d["extension_version"])), bold("PDF page", known(d["page_number"])),
        bold("Reading position", known(d["reading_position"]), F.lit(" / "), known(d["reading_items"])), bold("Equations", known(d["equation_count"]), F.lit(" ("), known(d["unresolved_count"]), F.lit(" unresolved)")),
        bold("Document", known(d["document_name"], "not provided")), bold("Browser", known(d["browser"])), F.lit(""), F.lit("## Description"), safe_code_block(r["description"]),
    ]
    none = F.array().cast("array<string>")
    excerpt = F.when(_text(r["selection_excerpt"]) != "", F.array(F.lit(""), F.lit("## Selected excerpt"), F.lit("```text"), safe_code_block(r["selection_excerpt"]), F.lit("```"))).otherwise(none)
    image = F.when(_text(image_url) != "", F.array(F.lit(""), F.lit("## Private page capture"), image_url)).otherwise(none)
    return F.array_join(F.concat(F.array(*lines), excerpt, image), "\n")


def invalid(r: Column) -> Column:
    """Why a received report (a struct as build_report gives) is rejected, or null."""
    image = _text(r["page_image"])
    png = image.rlike("(?i)\\Adata:image/png;base64,[a-z0-9+/=\\s]+\\z")
    return F.when(r.isNull(), "no report").when(trim(_text(r["description"])) == "", "no description").when((image != "") & ~png, "not a PNG image")


def received(r: Column, fresh_id: Column) -> Column:
    """A valid received report with its fields cut to size and its id replaced where that is odd."""
    d = r["diagnostics"]
    sizes = {"extension_version": 40, "browser": 300, "document_name": 240}
    return F.struct(
        F.lit(1).alias("schema_version"), F.when(r["report_id"].rlike("(?i)\\A[a-z0-9-]{8,80}\\z"), r["report_id"]).otherwise(fresh_id).alias("report_id"), cut_text(r["created_at"], 80).alias("created_at"),
        F.coalesce(F.nullif(cut_text(r["category"], 40), F.lit("")), F.lit("other")).alias("category"), cut_text(r["description"], MOST_DESCRIPTION).alias("description"),
        F.struct(*((cut_text(d[n], sizes[n]) if n in sizes else d[n]).alias(n) for n in DIAGNOSTICS)).alias("diagnostics"),
        F.nullif(cut_text(r["selection_excerpt"], MOST_EXCERPT), F.lit("")).alias("selection_excerpt"), F.nullif(_text(r["page_image"]), F.lit("")).alias("page_image"),
    )


def _url(c: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and path of an absolute URL, lower case where case does not count."""
    p = "\\A([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"
    return F.lower(F.regexp_extract(c, p, 1)), F.lower(F.regexp_extract(c, p, 2)), F.regexp_extract(c, p, 3)


def private_endpoint_allowed(endpoint: Column) -> Column:
    """Reports may go over https, or over http on this machine."""
    scheme, host, _ = _url(endpoint)
    return F.coalesce((scheme == "https") | ((scheme == "http") & host.isin("localhost", "127.0.0.1", "[::1]")), F.lit(False))


def public_endpoint_allowed(endpoint: Column) -> Column:
    scheme, host, path = _url(endpoint)
    return F.coalesce((scheme == "https") & (host == "github.com") & path.rlike("\\A/[^/]+/[^/]+/issues/new/?\\z"), F.lit(False))


def allowed_origin(origin: Column, allowed: Column) -> Column:
    """The origin a response names: any where none are listed, else the listed one, else null."""
    listed = F.filter(F.transform(F.split(_text(allowed), ","), trim), lambda v: v != "")
    return F.when(F.size(listed) == 0, "*").when(F.array_contains(listed, _text(origin)), _text(origin))


def public_issue_url(r: Column, endpoint: Column, words: dict[str, str]) -> Column:
    """A prefilled public issue: a short title, the report without its image; null where the address may not be used."""
    bare = r.withField("page_image", F.lit(None).cast("string"))
    summary = clipped(F.regexp_replace(r["description"], "\\s+", " "), MOST_TITLE)
    title = F.concat(F.lit("[Feedback "), r["category"], F.lit("] "), summary)
    return F.when(public_endpoint_allowed(endpoint), F.concat(endpoint, F.lit("?title="), F.url_encode(title), F.lit("&body="), F.url_encode(format_report(bare, words))))


def png_data_url(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)\\Adata:image/png[;,]"), F.lit(False))
