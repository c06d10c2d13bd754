import json

from threadmill import requests
from threadmill.functions.paths import repository_of, root_of_slug


def test_root_of_slug():
    there = {"/a", "/a/b-c", "/a/b-c/d", "/x", "/x-y"}
    find = lambda s: root_of_slug(s, there.__contains__)
    assert [find(s) for s in ("-a", "-x-y", "-a-b", "-", "", "a")] == ["/a", "/x-y", "", "", "", ""]
    assert root_of_slug("-a-b-c", {"/a", "/a/b", "/a/b/c", "/a/b-c"}.__contains__) == "/a/b/c"
    assert root_of_slug("-a-b-c", {"/a", "/a/b", "/a/b-c"}.__contains__) == "/a/b-c"


def test_repository_of():
    there = {"/a/b/.git", "/a/.git"}
    assert [repository_of(p, there.__contains__) for p in ("/a/b/c/d", "/a/c", "/z/y", "/")] == ["/a/b", "/a", "/z/y", "/"]


def test_hook():
    good = {"transcript_path": "/t.jsonl", "session_id": "s", "cwd": "/p"}
    assert requests.hook(json.dumps(good)) == {"transcript_path": "/t.jsonl", "session_id": "s", "project_root": "/p"}
    for bad in ("", " ", "{", "[]", json.dumps(good | {"cwd": ""}), json.dumps(good | {"session_id": None}), json.dumps(good | {"stop_hook_active": True})):
        assert requests.hook(bad) is None


def test_index_and_watch():
    body = json.dumps({"transcript_path": "/t.jsonl", "session_id": "s", "cwd": "/p"})
    ask = lambda text, header="", there=True: requests.index(text, header, lambda _: there)
    assert ask(body)[1]["project_root"] == "/p" and ask(body, " /q ")[1]["project_root"] == "/q"
    assert [ask("{")[0], ask("{}")[0], ask(body, there=False)[0], ask(body.replace("/p", ""))[0]] == [400, 400, 404, 400]
    assert requests.watch("", "/h") == (200, {"project_root": "/h"}) and requests.watch('{"cwd": "/c"}')[1] == {"project_root": "/c"} and requests.watch("no")[0] == 400
