"""The labelled table that the block classifier is trained on: invented pages.

``{n}`` stands for n words. A block of text that begins with ``§`` belongs to the main
text, all others do not. Where elements or names tell the main part, size does not: those
pages count in several sizes.
"""

from __future__ import annotations

MENU = "<ul><li><a href=/a>{1}</a></li><li><a href=/b>{1}</a></li><li><a href=/c>{2}</a></li><li><a href=/d>{1}</a></li></ul>"
SHORT = "<p>§{45}</p><p>§{2}</p><p>§{1}</p><p>§{9}</p><p>§{80}</p>"
LONG = "<p>§{120}</p><p>§{60}</p><p>§{3}</p><p>§{200}</p><p>§{14}</p>"

#: Sizes of the pages with a named main part, as multiples of the words stated.
SIZES = (0.1, 0.4, 1, 4)

NAMED = [
    # an article element between menus, adverts and a footer
    f"<body><nav>{MENU}</nav><div class=ad>{{7}}</div><article><h1>§{{6}}</h1>{SHORT}</article><footer>{{9}}</footer></body>",
    f"<body><nav>{MENU}</nav><div class=advert>{{14}}</div><article><h1>§{{4}}</h1><p>§{{1}}</p></article><footer>{{20}}</footer></body>",
    f"<body><header><h2>{{2}}</h2><p>{{5}}</p></header><article><h1>§{{8}}</h1>{LONG}</article><footer><p>{{30}}</p></footer></body>",
    f"<body><header>{MENU}</header><main><h1>§{{8}}</h1>{SHORT}<ul><li>§{{4}}</li><li>§{{2}}</li></ul></main><aside><p>{{40}}</p></aside></body>",
    "<body><article><header><h1>§{7}</h1><p>{4}</p></header><p>§{50}</p><p>§{1}</p><footer><p>{6}</p></footer></article></body>",
    "<body><article><h1>§{5}</h1><p>§{3}</p><p>§{2}</p></article><section id=comments><article><p>{60}</p></article><p>{8}</p></section></body>",
    "<body><article><p>§{30}</p><p>§<a href=/x>{4}</a></p><p>§{30} <a href=/y>{2}</a></p><ul><li><a href=/1>{6}</a></li><li><a href=/2>{7}</a></li><li><a href=/3>{5}</a></li></ul></article></body>",
    "<body><article><p>§{90}</p><aside>{25}</aside><p>§{4}</p><div class=share>{3}</div><form>{6}</form><p>§{90}</p></article><p>{12}</p></body>",
    "<body><article><p>§{20}</p></article><p>{70}</p><div>{6}</div><p>{2}</p></body>",
    "<body><article><p>§{20}</p></article><div>{90}</div><div>{60}</div></body>",
    "<body><p>{60}</p><p>{80}</p><p>{50}</p><article><h1>§{5}</h1><p>§{25}</p></article></body>",
    "<body><header><h2>{4}</h2><p>{80}</p></header><article><h1>§{4}</h1><p>§{20}</p></article><nav><p>{70}</p></nav><aside><h3>{2}</h3><p>{90}</p></aside></body>",
    "<body><article><p>§{20}</p></article><section id=comments><h3>{2}</h3><article><h4>{1}</h4><p>{120}</p></article><article><p>{50}</p></article></section></body>",
    "<body><article>§{40}</article><div class=sponsored><h3>{5}</h3><p>{60}</p></div></body>",
    "<body><main><p>§{40}</p><ul><li>§{8}</li><li>§{12}</li></ul><table><tr><td>§{1}</td><td>§{2}</td></tr></table><nav>{20}</nav></main></body>",
    "<body><div>{30}</div><main><p>§{12}</p><p>§{5}</p><blockquote>§{20}</blockquote></main><div>{4}</div></body>",
    "<body><article><p>§{1}</p></article><div class=ad>{1}</div></body>",
    "<body><article><p>§{10}</p><p>§<a href=/x>{6}</a></p></article><p>{1}</p></body>",
    "<body><article>§<a href=/x>{1}</a><ul><li><a href=/1>{1}</a></li><li><a href=/2>{1}</a></li></ul></article></body>",
    "<body><article><header><p>{2}</p><h1>§{6}</h1><p>{3}</p></header><p>§{40}</p></article><header><p>{4}</p><h2>{3}</h2></header></body>",
    "<body><article><header><div>{2}</div><h2>§{6}</h2><div>{9}</div></header><p>§{40}</p><h2>§{2}</h2><p>§{9}</p></article></body>",
    # a named division instead of an element
    f"<body><div id=menu>{MENU}</div><div id=content><h1>§{{6}}</h1>{SHORT}</div><div id=footer>{{12}}</div></body>",
    f"<body><div class=sidebar>{MENU}<p>{{35}}</p></div><div class=post-content><h2>§{{6}}</h2>{LONG}</div><div class=comments><p>{{50}}</p></div></body>",
    "<body><div class=header><h1>{3}</h1><p>{6}</p></div><div class=entry><p>§{60}</p><p>§{2}</p></div><p>{5}</p></body>",
    "<body><div class=content><div class=entry-header><h1>§{6}</h1><p>{4}</p></div><p>§{70}</p><p>§{30}</p></div><div>{10}</div></body>",
]

UNNAMED = [
    # words, links and neighbours decide
    "<body><p>§{20}</p></body>",
    f"<body>{MENU}<div><h1>§{{5}}</h1><p>§{{30}}</p><p>§{{25}}</p><p>§{{6}}</p></div></body>",
    f"<body><table><tr><td>{MENU}</td><td><p>§{{50}}</p><p>§{{45}}</p><p>§{{3}}</p></td></tr></table></body>",
    "<body><div><p>§{60}</p><p>§{2}</p></div></body>",
    "<body><h1>§{4}</h1><p>§{24}</p></body>",
    f"<body>{MENU}<p>§{{40}}</p><p>§{{3}}</p><p>§{{25}}</p>{MENU}<div>{{4}}</div></body>",
    f"<body><div>{MENU}</div><div>§{{30}}</div><div>{MENU}</div><div>{{3}}</div></body>",
    f"<body>{MENU}<div>{MENU}</div><div><div>{{3}}</div><div><h2>§{{5}}</h2><p>§{{22}}</p><p>§{{4}}</p><p>§{{31}}</p></div></div></body>",
    f"<body><div><p>{{3}}</p>{MENU}</div><div><p>§{{28}}</p></div><div><p>{{6}}</p></div></body>",
    "<body><div><a href=/a>{3}</a></div><div>{8}</div><div><p>§{500}</p><p>§{1}</p></div><div>{7}</div><div><a href=/b>{30}</a></div></body>",
    f"<body><div><p>§{{150}}</p><p>§{{90}}</p><ul><li><a href=/a>{{8}}</a></li><li><a href=/b>{{9}}</a></li></ul></div>{MENU}</body>",
    f"<body>{MENU}<div><h1>§{{6}}</h1>{LONG}</div><div>{{6}}</div><div>{{3}}</div></body>",
    f"<body><div>{MENU}</div><div><p>§{{40}}</p><p>§{{2}}</p><p>§{{50}}</p></div><div><p>{{4}}</p><p>{{5}}</p></div>{MENU}</body>",
    f"<body><table><tr><td>{MENU}</td><td><p>§{{80}}</p><p>§{{5}}</p><p>§{{70}}</p></td></tr></table><p>{{6}}</p></body>",
    "<body><p><a href=/a>{1}</a> | <a href=/b>{1}</a> | <a href=/c>{1}</a></p><h1>§{5}</h1><p>§{35}</p><p>§{60}</p><p>§{28}</p><p><a href=/d>{2}</a> <a href=/e>{2}</a></p></body>",
    "<body><p>§{35}</p><p>§{25}</p><p>§{7}</p><p>§{45}</p></body>",
    "<body><div>§{90}</div><div>§{70}</div><div>§{8}</div><div>§{60}</div></body>",
    "<body><div>{2}</div><div>{4}</div><div><a href=/a>{5}</a></div><div><a href=/b>{6}</a></div><div>{3}</div></body>",
    "<body><div><a href=/a>{9}</a> {12}</div><div><a href=/b>{8}</a> {11}</div><div><a href=/c>{10}</a> {14}</div></body>",
    "<body><div>§{55} <a href=/x>{3}</a></div><div>§{44}</div><div><a href=/y>{12}</a></div><div>{4}</div></body>",
    "<body><div><div>{5}</div></div><div><h1>§{7}</h1><div>§{75}</div><div>§{65}</div></div><div><div>{9}</div></div><div><div>{4}</div></div></body>",
]

#: Boilerplate with a name, main text without one.
HALF_NAMED = [
    f"<body><div class=nav>{MENU}</div><p>§{{30}}</p><p>§{{4}}</p><p>§{{90}}</p><div class=cookie-notice>{{40}}</div><div id=sidebar><p>{{50}}</p></div></body>",
    "<body><h1>§{6}</h1><p>§{60}</p><p>§{40}</p><div class=related><p>{20}</p><p>{30}</p></div><div class=comment><p>{45}</p></div><form><p>{25}</p></form></body>",
    "<body><header><h1>{4}</h1></header><p>§{60}</p><p>§{35}</p><footer><p>{40}</p></footer></body>",
    f"<body><nav>{MENU}</nav><div class=ad>{{20}}</div><div><h1>§{{6}}</h1><p>§{{30}}</p><p>§{{60}}</p></div><footer>{{25}}</footer></body>",
    "<body><div class=banner><p>{30}</p></div><div><p>§{40}</p><p>§{45}</p></div><div id=comments><p>{40}</p><p>{90}</p></div><div class=popup>{30}</div></body>",
    f"<body><div class=menu>{MENU}</div><div class=header><p>{{40}}</p></div><p>§{{50}}</p><p>§{{50}}</p><aside><p>{{70}}</p></aside></body>",
]
HALF_NAMED_SIZES = (1, 2, 5)

#: (page, multiple of its words)
TABLE = [(p, k) for p in NAMED for k in SIZES] + [(p, 1) for p in UNNAMED] + [(p, k) for p in HALF_NAMED for k in HALF_NAMED_SIZES]
