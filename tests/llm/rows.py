"""Small tables with every awkward row."""

SMALL, CHECKED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = "lorem ipsum dolor sit amet " * 6000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 5),
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a", 5),  # a repeated row
    (2, "the quick BROWN fox jumps over the lazy dog. " * 3, "en", "b", 5),  # equal but for case
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n\x0b\x0c\r ", "", "", 0),
    (None, "Released under the MIT License. Mail me: a.b@example.com or +1 (555) 010-9999.", "en", "a", 1),
    (None, None, None, None, None),
    (7, LONG, "en", "c", len(LONG)),
    (8, "Été ça va? Ünïcödé     line İstanbul ﬀ 𝒳 日本語テキスト é", "fr", "b", 3),
    (9, "4111 1111 1111 1111 and 10.0.0.256 and 10.0.0.25 and x@y and +12 345", "en", "b", 3),
    (10, "Licensed under the Apache License, Version 2.0. General public license general PUBLIC license", "en", "a", 3),
    (11, "a\na\n\nb c\nb c\nb  c", "en", "a", 3),
    (12, "<|endoftext|> it's 12,345 ''quoted'' &&& *** don't", "en", "ü", 3),
    (13, "one two three four five six seven eight nine " * 4, "en", "ü", 3),
    (14, "!!! ??? ...", "en", "c", 3),
    (15, "mit license mit license", "de", "c", 3),
    (16, "general public", "de", "c", 3),
]
PAGES = [
    (1, "http://h.example/a", "<html><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two <b>three</b>.</p><p>Four</article><footer>&copy; x</footer></body></html>"),
    (1, "http://h.example/a", "<html><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two <b>three</b>.</p><p>Four</article><footer>&copy; x</footer></body></html>"),
    (2, "http://h.example/b", None),
    (3, None, ""),
    (None, "nonsense", "plain   words &lt;only&gt;"),
    (5, "http://h.example/c", "<p>unclosed <b>bold<p>next <script>var x='<p>no</p>'</script>after<!-- c --></p><div class='ad box'>Buy</div>"),
    (6, "http://h.example/d", "<article><p>text</p><section class='comments'><p>Nice!</p></section><form><p>Mail</p></form><ul><li>x<li>y</ul></article><"),
]
VECTORS = [(i, [float((i * k) % 7 - 3) / 2 for k in range(1, 5)], 0) for i in range(0, 160)]
VECTORS += [(200, None, 0), (250, [None, 1.0, 2.0, 3.0], 0), (300, [float("nan"), 1.0, 1.0, 1.0], 0), (350, [float("inf"), 0.0, 0.0, 0.0], 0), (400, [], 0), (None, [1.0, 1.0, 1.0, 1.0], 0), (50, [9.0, 9.0, 9.0, 9.0], 1), (450, [0.0, 0.0, 0.0, 0.0], 1)]
SCHEMAS = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", DOCS),
    "pages": ("page_id long, url string, html string", PAGES),
    "embeddings": ("vec_id long, embedding array<float>, label int", VECTORS),
}


def write(spark, folder, rows=True, more=None):
    for name, (schema, content) in SCHEMAS.items():
        df = spark.createDataFrame(content if rows else [], schema)
        (more(df) if more else df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
