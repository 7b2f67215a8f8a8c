"""Reports as text and HTML, on the driver, from tables that one reader can read (2.J, A29-A32, B43, B60-B64).

Each function takes a DataFrame of one report, a few hundred rows at most, and says so by a bound: a
larger one is an error, never a silent cut.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

#: Rows that a page may hold.
ROWS_MOST = 20_000


def _rows(df: DataFrame, *order: str) -> list:
    rows = df.orderBy(*order).limit(ROWS_MOST + 1).collect()
    if len(rows) > ROWS_MOST:
        raise ValueError(f"a page holds at most {ROWS_MOST} rows")
    return rows


def cell(value: object) -> str:
    """A value as a cell of a table: pipes escaped, newlines as spaces, null as nothing."""
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, columns: list[str], order: list[str], strong: str | None = None, when: tuple[str, ...] = ("contradicted", "absent", "unsupported", "error")) -> str:
    """A table in Markdown; values of the column ``strong`` that are among ``when`` are bold."""
    out = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in _rows(df, *order):
        out.append("| " + " | ".join(f"**{cell(r[c])}**" if c == strong and r[c] in when else cell(r[c]) for c in columns) + " |")
    return "\n".join(out) + "\n"


def counted(n: int, one: str, many: str | None = None) -> str:
    """A number with its noun in the right form."""
    return f"{n} {one if n == 1 else many or one + 's'}"


def tree_text(nodes: DataFrame, judged: DataFrame) -> str:
    """E6, 2.J: a tree as indented lines with the judgement of each node and what decided it."""
    rows = _rows(nodes.join(judged, "node", "left").select("node", "parent", "ord", "judgement", "deciding"), "ord", "node")
    below: dict[str | None, list] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    out, stack = [], [(r, 0) for r in reversed(below.get(None, []))]
    while stack:
        r, depth = stack.pop()
        why = f" ({r['deciding']})" if r["deciding"] else ""
        out.append(f"{'  ' * depth}{r['node']}: {r['judgement'] or 'open'}{why}")
        stack.extend((k, depth + 1) for k in reversed(below.get(r["node"], [])))
    return "\n".join(out) + "\n"


def brief_text(title: str, pooled: DataFrame, show: int = 10) -> str:
    """G3, 2.J: the contested claims of a report first, ``show`` of each class, with how many more there are."""
    rows = _rows(pooled.select("claim_id", "verdict", "spread", "dissent", "stability"), "claim_id")
    out = [f"# {title}", ""]
    for cls in ("contested", "wobble", "settled"):
        own = [r for r in rows if r["stability"] == cls]
        if own:
            out.append(f"## {cls} ({counted(len(own), 'claim')})")
            out += [f"- {r['claim_id']}: {r['verdict']} {r['spread']}{' ≠ ' + r['dissent'] if r['dissent'] else ''}".rstrip() for r in own[:show]]
            if len(own) > show:
                out.append(f"- and {len(own) - show} more")
            out.append("")
    return "\n".join(out)


def page_html(title: str, df: DataFrame, columns: list[str], order: list[str]) -> str:
    """A table as a page; every value is escaped."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "\n".join("<tr>" + "".join(f"<td>{html.escape('' if r[c] is None else str(r[c]))}</td>" for c in columns) + "</tr>" for r in _rows(df, *order))
    return f"<!doctype html>\n<meta charset=utf-8>\n<title>{html.escape(title)}</title>\n<h1>{html.escape(title)}</h1>\n<table><thead><tr>{head}</tr></thead>\n<tbody>\n{body}\n</tbody></table>\n"


LINK = re.compile(r"""(?:href|src)=["']([^"'#?]+)|\]\(([^)#?\s]+)""")


def links_of(text: str) -> list[str]:
    """The local files that a page refers to, each once, in order; those with a scheme are left out."""
    found = (a or b for a, b in LINK.findall(text))
    return list(dict.fromkeys(x for x in found if not re.match(r"[a-z][a-z0-9+.-]*:", x)))


def relinked(text: str, moved: dict[str, str]) -> str:
    """A page with its links to moved files rewritten."""
    def to(m: re.Match) -> str:
        old = m[1] or m[2]
        return m[0].replace(old, moved[old]) if old in moved else m[0]

    return LINK.sub(to, text)
