"""Plain text and Markdown."""

from __future__ import annotations

import re

HEADING = re.compile(r"(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})\s*([\w+-]*)")


def section(text: str, first: int, last: int, path: list[str] | None = None, symbol: str | None = None, **metadata) -> dict:
    return {"heading_path": path or [], "text": text, "line_start": first, "line_end": last, "symbol": symbol, "metadata": metadata}


def document(sections: list[dict], content_type: str, *, title: str | None = None, language: str | None = None, **metadata) -> dict:
    return {"title": title, "sections": sections, "metadata": metadata, "content_type": content_type, "language": language}


def plaintext(text: str) -> dict:
    """One section of all lines."""
    return document([section(text, 1, len(text.splitlines()) or 1)], "text/plain")


def _frontmatter(lines: list[str]) -> tuple[dict, int]:
    """(fields, lines taken) of a leading ``---`` block."""
    if not lines or lines[0].strip() != "---":
        return {}, 0
    end = next((i for i in range(1, len(lines)) if lines[i].strip() in ("---", "...")), 0)
    if not end:
        return {}, 0
    import yaml

    try:
        found = yaml.safe_load("\n".join(lines[1:end]))
    except yaml.YAMLError:
        found = None
    return (found if isinstance(found, dict) else {}), end + 1


def markdown(text: str) -> dict:
    """A section per heading with the path of headings above it; each source line lies in one section, headings in none."""
    lines = text.splitlines()
    fields, at = _frontmatter(lines)
    path: list[tuple[int, str]] = []
    sections, languages, body, start, fence, first_h1 = [], [], [], at + 1, "", None

    def close(last: int) -> None:
        joined = "\n".join(body).strip("\n")
        if joined.strip():
            sections.append(section(joined, start, last, [t for _, t in path], level=path[-1][0] if path else 0))
        body.clear()

    for number, line in enumerate(lines[at:], at + 1):
        mark = FENCE.match(line)
        if mark and not fence:
            fence = mark[1]
            if mark[2] and mark[2] not in languages:
                languages.append(mark[2])
        elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2]:
            fence = ""
        elif not fence and (heading := HEADING.match(line)):
            close(number - 1)
            level, title = len(heading[1]), heading[2].strip()
            path = [p for p in path if p[0] < level] + [(level, title)]
            first_h1 = first_h1 or (title if level == 1 else None)
            start = number + 1
            continue
        body.append(line)
    close(len(lines))
    return document(sections, "text/markdown", title=str(fields["title"]) if fields.get("title") else first_h1, frontmatter={k: str(v) for k, v in fields.items()}, code_languages=languages)


def notion_blocks(blocks: list[dict], depth: int = 0) -> str:
    """Blocks as Markdown: indented by depth, unknown kinds as comments."""
    pad, out = "  " * depth, []
    number = 0
    for block in blocks:
        kind = block.get("type", "")
        data = block.get(kind) or {}
        words = "".join(t.get("plain_text", "") for t in data.get("rich_text") or data.get("title") or [])
        number = number + 1 if kind == "numbered_list_item" else 0
        simple = {"paragraph": words, "heading_1": f"# {words}", "heading_2": f"## {words}", "heading_3": f"### {words}", "bulleted_list_item": f"- {words}", "numbered_list_item": f"{number}. {words}", "to_do": f"- [{'x' if data.get('checked') else ' '}] {words}", "toggle": f"- {words}", "quote": f"> {words}", "callout": f"> {words}", "divider": "---", "equation": f"$${data.get('expression', '')}$$", "child_page": f"[{data.get('title', '')}]", "child_database": f"[{data.get('title', '')}]"}
        if kind == "code":
            out.append(f"{pad}```{data.get('language', '')}\n{words}\n{pad}```")
        elif kind in ("image", "file", "pdf", "video"):
            at = (data.get("external") or data.get("file") or {}).get("url", "")
            out.append(f"{pad}{'!' if kind == 'image' else ''}[{kind}]({at})")
        elif kind in ("bookmark", "embed", "link_preview"):
            out.append(f"{pad}[{data.get('url', '')}]({data.get('url', '')})")
        elif kind == "table_row":
            out.append(pad + "| " + " | ".join("".join(t.get("plain_text", "") for t in cell) for cell in data.get("cells", [])) + " |")
        elif kind in simple:
            out.append(pad + simple[kind] if simple[kind] else "")
        elif kind not in ("table", "column_list", "column", "synced_block"):
            out.append(f"{pad}<!-- {kind} -->")
        if block.get("children"):
            out.append(notion_blocks(block["children"], depth + (kind in ("bulleted_list_item", "numbered_list_item", "to_do", "toggle"))))
    return "\n".join(x for x in out if x is not None)


def notion_property(value: dict):
    """A typed property as text, number, list or flag; other kinds as None."""
    kind = value.get("type", "")
    raw = value.get(kind)
    if kind in ("title", "rich_text"):
        return "".join(t.get("plain_text", "") for t in raw or [])
    if kind in ("select", "status"):
        return (raw or {}).get("name")
    if kind == "multi_select":
        return [x.get("name") for x in raw or []]
    if kind == "date":
        return (raw or {}).get("start")
    return raw if kind in ("checkbox", "number", "url", "email", "phone_number") else None


def adf(node: dict | list | None, depth: int = 0) -> str:
    """A rich-text tree (content, marks, lists, tables, mentions, cards) as Markdown."""
    if not node:
        return ""
    if isinstance(node, list):
        return "".join(adf(x, depth) for x in node)
    kind, inner, attrs = node.get("type", ""), node.get("content") or [], node.get("attrs") or {}
    if kind == "text":
        out = node.get("text", "")
        for mark in node.get("marks") or []:
            m = mark.get("type")
            wrap = {"strong": "**", "em": "*", "code": "`", "strike": "~~"}.get(m)
            out = f"{wrap}{out}{wrap}" if wrap else f"[{out}]({(mark.get('attrs') or {}).get('href', '')})" if m == "link" else out
        return out
    if kind in ("bulletList", "orderedList"):
        rows = []
        for i, item in enumerate(inner, 1):
            head = f"{i}. " if kind == "orderedList" else "- "
            rows.append("  " * depth + head + adf(item.get("content"), depth + 1).strip())
        return "\n".join(rows) + "\n"
    if kind == "table":
        return "\n".join("| " + " | ".join(adf(c.get("content"), depth).strip() for c in row.get("content") or []) + " |" for row in inner) + "\n"
    body = adf(inner, depth)
    leaf = {"hardBreak": "\n", "rule": "---\n", "mention": attrs.get("text", ""), "emoji": attrs.get("text") or attrs.get("shortName", ""), "inlineCard": attrs.get("url", ""), "blockCard": attrs.get("url", "") + "\n"}
    if kind in leaf:
        return leaf[kind]
    if kind == "heading":
        return "#" * int(attrs.get("level", 1)) + " " + body + "\n\n"
    if kind == "codeBlock":
        return f"```{attrs.get('language', '')}\n{body}\n```\n"
    if kind == "blockquote":
        return "\n".join("> " + x for x in body.strip().split("\n")) + "\n"
    return body + "\n\n" if kind == "paragraph" else body
