"""A fetch function for tests: what a URL's path says becomes of it."""

calls: dict[str, int] = {}


def fetch(url):
    calls[url] = calls.get(url, 0) + 1
    what = url.rsplit("/", 1)[-1]
    if what == "flaky":
        return (200, "text/html", "late", None) if calls[url] > 1 else (0, None, None, "timeout")
    return {
        "gone": (0, None, None, "dns_nxdomain"), "down": (0, None, None, "conn_reset"), "limit": (429, "text/html", "wait", None),
        "image": (200, "image/png", "png", None), "lost": (404, "text/html", "not here", None), "big": (200, "text/html", "x" * (1 << 21), None),
    }.get(what, (200, "text/html", what, None))
