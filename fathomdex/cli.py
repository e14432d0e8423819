"""A read-eval-print loop over the store: python -m fathomdex.cli [--data DIR | --demo]."""

from __future__ import annotations

import sys

from fathomdex.functions.text import snippet
from fathomdex.operators.store import Engine, StoreError
from fathomdex.plans.query_lang import QueryError

HELP = """put <id> "<title>" "<body>"   add a document
get <id>                      show a document
del <id>                      delete a document
list                          live documents
search <query>                the ten best hits
flush                         seal the buffer
merge                         combine segments of like size
stats                         counts and bytes
help, quit"""


def split_args(text: str) -> list[str]:
    """Words at white space; a quote at a word's start runs to the next quote, with backslash escapes."""
    out, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
        elif text[i] == '"':
            word, i = [], i + 1
            while i < len(text) and text[i] != '"':
                i += text[i] == "\\" and i + 1 < len(text)
                word.append(text[i])
                i += 1
            if i >= len(text):
                raise StoreError("unterminated quote")
            out.append("".join(word))
            i += 1
        else:
            end = next((k for k in range(i, len(text)) if text[k].isspace()), len(text))
            out.append(text[i:end])
            i = end
    return out


def handle(engine: Engine, line: str) -> str | None:
    """The answer to one command; None to leave."""
    command, _, rest = line.strip().partition(" ")
    try:
        if command in ("quit", "exit"):
            engine.flush()
            return None
        if command == "search":
            return _search(engine, rest)
        args = split_args(rest)
        if command == "put":
            if len(args) != 3:
                return 'usage: put <id> "<title>" "<body>"'
            put = engine.put(*args)
            where = f"auto-flushed {put.flushed}, {put.documents} docs" if put.flushed else f"{put.active} in the active segment"
            return f"ok  {args[0]}  ({where})"
        if command == "get":
            return "\n".join(found) if (found := engine.get(args[0])) else "no such document"
        if command == "del":
            engine.remove(args[0])
            return f"tombstoned {args[0]}"
        if command == "list":
            return "\n".join(f"{r['id']}  {r['title']}" for r in engine.list().toLocalIterator()) or "no documents"
        if command == "flush":
            info = engine.flush()
            return f"sealed {info.segment} ({info.documents} docs)" if info.segment else "nothing to flush"
        if command == "merge":
            info = engine.merge()
            return {"merged": f"merged into {info.segment}", "emptied": "merged to an empty index", "none": "no segments on disk", "single": "already one segment", "kept": "left the larger segment alone"}[info.outcome]
        if command == "stats":
            return "\n".join(f"{k:<16} {v}" for k, v in vars(engine.stats()).items())
        return HELP if command == "help" else "" if not command else f"unknown command: {command}"
    except (StoreError, QueryError, IndexError) as e:
        return f"error: {e}"


def _search(engine: Engine, query: str) -> str:
    found = engine.search(query)
    if not found.total:
        return "no hits"
    hits = found.hits.collect()  # ten at most
    lines = [f"{found.total} hit{'s' * (found.total != 1)}"]
    for n, r in enumerate(hits, 1):
        lines += [f"  {n}. {r['score']:.3f}  {r['id']}  {r['title']}", f"     {snippet(r['body'])}"]
    return "\n".join(lines + [f"  ... {found.total - len(hits)} more"] * (found.total > len(hits)))


#: A self-check: commands, and what the answer must hold.
DEMO = (
    ('put otter "Small River Otter" "A small river otter dives under the cold bridge."', "1 in the active segment"),
    ('put heron "Cold Heron" "The cold heron waits after chasing an otter."', "2 in the active segment"),
    ("search otters", "2 hits"),
    ('search "small river"', "1 hit"),
    ("search otter -heron", "1. "),
    ("search NOT otter", "no hits"),
    ("search the", "error: query has no searchable terms"),
    ('put otter "x" "y"', "error: document already indexed: otter"),
    ("flush", "sealed seg-000001 (2 docs)"),
    ('put gears "Mill Gears" "Old mills turn wooden gears."', "1 in the active segment"),
    ("del heron", "tombstoned heron"),
    ("search chasing", "no hits"),
    ("merge", "merged into seg-000003"),
    ("search mill", "gears"),
    ("list", "otter  Small River Otter\ngears  Mill Gears"),
    ("get heron", "no such document"),
    ("del gears", "tombstoned gears"),
    ("del otter", "tombstoned otter"),
    ("merge", "merged to an empty index"),
    ("list", "no documents"),
)


def demo(spark, folder: str) -> list[str]:
    """Runs the self-check in an empty folder, the store opened anew before each command: what failed."""
    wrong = []
    for line, holds in DEMO:
        said = handle(Engine(spark, folder), line)
        if holds not in (said or ""):
            wrong.append(f"{line}: {said!r} instead of {holds!r}")
    return wrong


def main(argv: list[str]) -> int:
    folder, check = "index_data", False
    args = iter(argv)
    for a in args:
        if a in ("--help", "-h"):
            print(f"--data DIR, or --demo for a self-check\n{HELP}")
            return 0
        if a == "--demo":
            check = True
            continue
        if a != "--data" or (folder := next(args, None)) is None:
            print(f"unknown option: {a}", file=sys.stderr)
            return 2
    from fathomdex.session import local_session

    if check:
        import tempfile

        with tempfile.TemporaryDirectory() as own:
            wrong = demo(local_session(), own)
        print("\n".join(wrong) or f"self-check passed ({len(DEMO)} commands)")
        return int(bool(wrong))
    try:
        engine = Engine(local_session(), folder)
        for line in sys.stdin:
            if (said := handle(engine, line)) is None:
                return 0
            if said:
                print(said)
        engine.flush()
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
