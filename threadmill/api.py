"""What a user calls (API1, FL13, SK10, SR8): searches, context and statistics over a store, as tables or as text."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from threadmill.functions import text as T
from threadmill.operators import fulltext, fusion, sessions, vectors
from threadmill.store import Store


def scope(project: str | None, current: str | None) -> str | None:
    """FL13: '*' is every project, another value that project, none the current one."""
    return None if project == "*" else project or current


def _search(store: Store, query: str, n: int, recency: bool, embedder=vectors.Hashing, date_from: str | None = None, date_to: str | None = None, **equal: str | None) -> DataFrame:
    stored = store.turns()
    where = T.equal_filters(**equal) & T.date_filters("timestamp", date_from, date_to)
    vector = [float(x) for x in embedder().embed([query], True)[0]]
    return fusion.hybrid(fulltext.index(stored), vectors.embedded(stored, "content", embedder), query, vector, n, where, recency, store.settings)


def search_session(store: Store, query: str, n: int = 5, session_id: str | None = None, project: str | None = None, current: str | None = None) -> DataFrame:
    """The project's turns, by recency."""
    return _search(store, query, n, True, session_id=session_id, project_root=scope(project, current))


def search_all_sessions(store: Store, query: str, n: int = 10, git_branch: str | None = None, project: str | None = "*", date_from: str | None = None, date_to: str | None = None, current: str | None = None) -> DataFrame:
    return _search(store, query, n, False, date_from=date_from, date_to=date_to, git_branch=git_branch, project_root=scope(project, current))


def get_turns(store: Store, session_id: str, turn_index: int, context: int = 2) -> DataFrame:
    target = store.spark.createDataFrame([(session_id, turn_index)], "session_id string, turn_index bigint")
    return sessions.context(store.turns(), target, context).orderBy("turn_index", "doc_id")


def _body(head: str, meta: str, content: str) -> str:
    return f"{head}\n{meta}\n\n{content}\n\n---\n"


def results_text(rows: Iterable[Row]) -> str:
    out = []
    for r in rows:
        parts = [f"**Result {r['rank']}**", *([f"({r['timestamp'][:19]})"] if r["timestamp"] else []), *([f"[{r['git_branch']}]"] if r["git_branch"] else [])]
        parts += [f"project:{r['project_root'].rstrip('/').rpartition('/')[2]}"] if r["project_root"] else []
        parts += [f"session:{r['session_id']}"] if r["session_id"] else []
        out.append(_body(" ".join(parts), f"*Turn: {r['turn_index']} | Type: {r['chunk_type']} | Relevance: {1 - r['distance']:.2f}*", r["content"]))
    return "\n".join(out) or "No results found."


def turns_text(rows: Iterable[Row]) -> str:
    out = []
    for r in rows:
        parts = [f"**Turn {r['turn_index']}**", *([f"({r['timestamp'][:19]})"] if r["timestamp"] else []), *([f"[{r['git_branch']}]"] if r["git_branch"] else [])]
        out.append(_body(" ".join(parts), f"*Type: {r['chunk_type']}*", r["content"]))
    return "\n".join(out) or "No turns found."


def statistics_text(store: Store) -> str:
    total, kinds = store.statistics().first(), sessions.by_type(store.turns()).orderBy(F.desc("n"), "chunk_type").collect()
    out = [f"**Total Turns:** {total['total_turns']}", f"**Sessions:** {total['sessions']}"]
    out += [f"**Branches:** {total['branches']}"] if total["branches"] else []
    out += ["", "### By Type", *[f"- {k['chunk_type']}: {k['n']}" for k in kinds]] if kinds else []
    return "\n".join([*out, "", f"**Index Location:** {store.folder}"])


def session_table(store: Store) -> str:
    """SK11, AG8: a row a session and the totals."""
    rows = store.sessions().collect()  # one row a session, for a terminal
    lines = [f"{r['session_id']:<38} {r['turns']:>6} {r['first_seen'][:19]:<20} {r['last_seen'][:19]:<20} {r['branches']}" for r in rows]
    return "\n".join([*lines, f"{len(rows)} sessions, {sum(r['turns'] for r in rows)} turns"])
