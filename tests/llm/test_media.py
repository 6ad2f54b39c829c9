import hashlib
import zlib

from corpus import documents, frame, result

from verdure.llm import media


def test_payloads_survive_storage(spark):
    got = result(media.documents_as_media(frame(spark)))
    assert len(got) == len(documents())
    want = []
    for doc_id, text, *_ in documents():
        data = (text or "").encode()
        payload = data + b"\0" * (64 if not data else -len(data) % 64)
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload
        want.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got)


def test_sequences_keep_order_captions_and_references(spark):
    html = "<p>One <b>two</b></p><figure><img src='sha256:ab' alt='x'><figcaption>Cap  tion</figcaption></figure><script>no</script>Tail"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<img src=a.png alt=only>")], "page_id long, html string")
    got = {r["page_id"]: [tuple(i) for i in r["items"]] for r in media.sequences(pages).collect()}
    assert got[1] == [(0, "text", "One two", None, None), (1, "media", None, "ab", "Cap tion"), (2, "text", "Tail", None, None)]
    assert got[2] == [] and got[3] == [] and got[4][0][4] == "only"
    stored = spark.createDataFrame([("ab", bytearray(media.to_png(b"\1" * 64)))], "digest string, media binary")
    rows = {(r["page_id"], r["position"]): r for r in media.resolved(media.sequences(pages), media.features(stored)).collect()}
    assert rows[1, 1]["payload_bytes"] == 64 and rows[1, 1]["caption"] == "Cap tion" and rows[4, 0]["payload_bytes"] is None


def test_captions_stay_with_their_figure(spark):
    img = lambda d, alt=None: {"kind": "media", "text": None, "digest": d, "caption": alt}
    text = lambda t: {"kind": "text", "text": t, "digest": None, "caption": None}
    cases = {
        "<img src='sha256:a'><figure><figcaption>of b</figcaption><img src='sha256:b'></figure>": [img("a"), img("b", "of b")],
        "<figure><img src='sha256:a'><img src='sha256:b' alt='x'><figcaption>both</figcaption></figure><img src='sha256:c' alt='own'>": [img("a", "both"), img("b", "both"), img("c", "own")],
        "<figure><img src='sha256:a'><figcaption>never closed": [img("a", "never closed")],
        "<figure><img src='sha256:a'><figcaption>cap<p>more</figure>after": [img("a", "capmore"), text("after")],
        "one<figure><figcaption>no picture</figcaption></figure>two": [text("one"), text("no picture"), text("two")],
        "<figcaption>loose</figcaption>end": [text("loose"), text("end")],
        "<figure><img src='sha256:a'><figure><img src='sha256:b'><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>": [img("a", "outer"), img("b", "inner")],
        "a &lt;b&gt; <script>x<img src=y></script><br>c": [text("a <b>"), text("c")],
    }
    for html, want in cases.items():
        got = [{k: v for k, v in i.items() if k != "position"} for i in media.parse(html)]
        assert got == want, html
        assert [i["position"] for i in media.parse(html)] == list(range(len(want)))


def test_lines_of_a_text_are_blocks_around_its_reference(spark):
    rows = {r["doc_id"]: r for r in result(media.documents_as_media(frame(spark, [(1, "one <b> & two\n\nthree\nfour", "en", "a", 0), (2, None, "en", "a", 0), (3, "x" * 700_000 + "\n&amp;", "en", "a", 0)])))}
    assert (rows[1]["n_blocks"], rows[1]["position"]) == (3, 1) and (rows[2]["n_blocks"], rows[2]["position"]) == (0, 0)
    assert rows[3]["n_bytes"] == 700_006 and rows[3]["n_blocks"] == 2


def test_empty_table(spark):
    assert media.documents_as_media(frame(spark, [])).count() == 0
