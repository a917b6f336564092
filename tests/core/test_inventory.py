"""Runs that list and read only what is new."""

import os
import time

from pyspark.sql import functions as F

from quillstack.sources.inventory import Inventory
from quillstack.sources.readers import read_raw_pages


def write(root, thread, page, text):
    folder = root / thread / "raw_html"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"page_{page:04d}.html").write_bytes(text)


def shown(df):
    return sorted((x.thread_id, x.page, x.html) for x in df.collect())


def test_a_second_run_lists_new_folders_only(spark, tmp_path):
    root = tmp_path / "archive"
    inventory = Inventory(spark, str(root), f"{tmp_path}/inventory")
    assert inventory.refresh() == (0, 0) and inventory.files().count() == 0
    for thread in ("a", "b", "c d"):
        for page in (1, 2):
            write(root, thread, page, b"bad \xff " + thread.encode())
    (root / "a" / "raw_html" / "page_x.html").write_text("no page")
    (root / "empty").mkdir()
    run, listed = inventory.refresh()
    assert (run, listed) == (1, 3) and inventory.files().count() == 6
    assert shown(inventory.new_pages(1)) == shown(read_raw_pages(spark, str(root)))
    assert inventory.refresh() == (1, 0)  # nothing has changed: nothing is listed
    time.sleep(0.05)
    write(root, "b", 3, b"third")
    write(root, "new", 1, b"first")
    assert inventory.refresh() == (2, 2)
    assert shown(inventory.new_pages(2)) == [("b", 3, "third"), ("new", 1, "first")]
    assert inventory.files().count() == 8 and inventory.files().agg(F.sum("length")).first()[0] == sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(root) for f in names if f != "page_x.html")


def test_a_file_written_again_is_new(spark, tmp_path):
    root = tmp_path / "archive"
    inventory = Inventory(spark, str(root), f"{tmp_path}/inventory")
    write(root, "a", 1, b"old")
    write(root, "a", 2, b"stays")
    assert inventory.refresh() == (1, 1)
    time.sleep(1.1)
    os.remove(root / "a" / "raw_html" / "page_0001.html")
    write(root, "a", 1, b"new text")
    assert inventory.refresh() == (2, 1)
    assert shown(inventory.new_pages(2)) == [("a", 1, "new text")]
    assert sorted((x.page, x.run) for x in inventory.files().collect()) == [(1, 2), (2, 1)] and shown(inventory.new_pages(9)) == []
