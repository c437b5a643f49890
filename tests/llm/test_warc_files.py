"""Archives as others would read them."""

import gzip

import pyarrow.fs as pafs

from palimpsest.llm import shared, warc


def test_files_begin_with_information_and_records_have_names(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, None, None), (None, None, "y")], "page_id long, url string, html string")
    manifest = warc.write(pages, shared.shared_dir(spark), roll_bytes=1)
    seen = []
    for row in manifest.collect():
        fs, at = pafs.FileSystem.from_uri(row["path"])
        with fs.open_input_stream(at, compression=None) as f:
            body = f.read()
        assert len(body) == row["n_bytes"] and row["n_records"] == 1
        with fs.open_input_stream(at, compression=None) as f:
            first, *rest = [warc.parse(m)[0] for m in warc.members(f)]
        assert first["WARC-Type"] == "warcinfo" and at.endswith(first["WARC-Filename"]) and gzip.decompress(body).startswith(b"WARC/1.1\r\n")
        assert all({"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length", "WARC-Target-URI"} <= set(h) for h in rest)
        seen += rest
    assert len(seen) == 4 and len({h["WARC-Record-ID"] for h in seen}) == 4
    assert sorted((r["page_id"] or 0, r["url"], r["record_type"]) for r in warc.read(manifest).collect()) == [(0, None, "response"), (1, "http://a", "response"), (2, None, "revisit"), (3, None, "response")]
