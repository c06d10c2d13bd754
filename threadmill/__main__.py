"""``python -m threadmill STORE list|stats|expire DAYS|delete [--session S] [--branch B]|reset|backfill FOLDER|search QUERY`` (API2)."""

import argparse

from pyspark.sql import SparkSession

from threadmill import api
from threadmill.store import Store
from threadmill.streaming import backfill


def main() -> None:
    top = argparse.ArgumentParser(prog="threadmill")
    top.add_argument("store")
    do = top.add_subparsers(dest="do", required=True)
    for name in ("list", "stats", "reset"):
        do.add_parser(name)
    do.add_parser("expire").add_argument("days", type=int)
    delete = do.add_parser("delete")
    delete.add_argument("--session")
    delete.add_argument("--branch")
    do.add_parser("backfill").add_argument("folder")
    do.add_parser("search").add_argument("query")
    args = top.parse_args()
    store = Store(SparkSession.builder.appName("threadmill").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args.store)
    if args.do == "list":
        print(api.session_table(store))
    elif args.do == "stats":
        print(api.statistics_text(store))
    elif args.do == "reset":
        store.reset()
    elif args.do == "expire":
        print(store.cleanup(max_age_days=args.days))
    elif args.do == "delete":
        print(store.cleanup(session_id=args.session, git_branch=args.branch))
    elif args.do == "backfill":
        backfill(store, args.folder)
    else:
        print(api.results_text(api.search_all_sessions(store, args.query).orderBy("rank").collect()))


if __name__ == "__main__":
    main()
