"""URL cases checked against the standard library, whose results are the expected ones."""

BASES = [
    "http://a.example/b/c/d;p?q#f", "https://h.example", "https://h.example/", "http://H.Example:80/x/y/",
    "https://u@h.example/a//b/../c.html?x=1", "http://h.example/a b/c",
]
HREFS = [
    "", "g", "./g", "g/", "/g", "//G.example/x/../y", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s",
    ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g",
    "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g#s/../x", "http:g", "http:", "https:g",
    "mailto:a@b", "javascript:void(0)", "HTTP://X.example/P?Q#F", "/für/x y", "a//b//c", "/a//b", " /lead", "/tail ",
    "/tab\tin", "tel:123", "?", "#", "a;", "a;?b", "//", "///x", "data:text/plain,hi#x", "a:b", "1a:b", "x/..;v",
    "../up;v=1?q=a%20b&q=c&z=&y=1+2#part", "?a=1&b=&c=%zz&d=%C3%A9&a=2&=x&flag", "ftp://f.example/a;type=i",
]
STORAGE = [
    "HTTP://WWW.Example.COM/Path/?Q=1#frag", "https://h.example/a;p?q", "https://h.example/a;?q", "https://h.example/a/;",
    "https://h.example?", "https://h.example/p?#f", "http:/x", "mailto:A@B", "//H.example/p", "/p#f", "https://H.example",
    "https://h.example/p??", " https://h.example/p", "https://h.example/a;b;", "https://h.example/a;/b", "",
]
