"""Names, tables and patterns that results must agree on."""

# Resource types.
BINARY, HTML, CSS, CSS_INLINE, SITEMAP, SVG, STREAMING = range(1, 8)

# URL schemes that are never followed.
SKIPPED_SCHEMES = (
    "about attachment blob cap chrome chrome-extension cid content cvs data dav dns drm ed2k example feed filesystem ftp geo git icon im imap info ipn ipp ipps irc irc6 ircs jar ldap ldaps magnet mailserver mailto maps market message mid mms modem ms-help ms-settings mvn news nfs oid pkcs11 platform pop redis rediss res resource rmi rsync rtmfp rtmp rtsp s3 service sftp shttp sip sips skype smb sms snews snmp spotify ssh steam svn tag tel telnet tftp udp unreal urn view-source vnc ws wss xri admin app javascript jdbc odbc unix"
).split()

# Extensions of links that are binary though an anchor points to them.
BINARY_EXTENSIONS = "gif jpg jpeg png js jsm json txt woff2 ttf ttc xul jar zip rar 7z tar gz bz2 xz mp3 ogg mp4 flv m4v mkv webm msi xpi rdf pdf dia eot psd".split()

# Content types by extension.
CONTENT_TYPES = {
    ".avif": "image/avif", ".css": "text/css; charset=utf-8", ".gif": "image/gif", ".htm": "text/html; charset=utf-8", ".html": "text/html; charset=utf-8",
    ".ico": "image/x-icon", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".js": "text/javascript; charset=utf-8", ".json": "application/json; charset=utf-8",
    ".mjs": "text/javascript; charset=utf-8", ".mp3": "audio/mpeg", ".mp4": "video/mp4", ".otf": "font/otf", ".pdf": "application/pdf", ".png": "image/png",
    ".svg": "image/svg+xml; charset=utf-8", ".ttf": "font/ttf", ".txt": "text/plain; charset=utf-8", ".wasm": "application/wasm", ".wav": "audio/wav",
    ".webm": "video/webm", ".webp": "image/webp", ".woff": "font/woff", ".woff2": "font/woff2", ".xml": "application/xml; charset=utf-8",
}

# Where links live: (element, needed ancestor, attribute, condition on another attribute, type). Attribute None: the element's text.
LINK_RULES = [
    ("style", None, None, None, CSS_INLINE),
    ("*", None, "style", None, CSS_INLINE),
    ("img", None, "src", None, BINARY),
    ("img", None, "srcset", None, BINARY),
    ("input", None, "src", None, BINARY),
    ("object", None, "data", None, BINARY),
    ("embed", None, "src", None, BINARY),
    ("param", None, "value", ("name", "=", "movie"), BINARY),
    ("script", None, "src", None, BINARY),
    ("link", None, "href", ("rel", "=", "stylesheet"), CSS),
    ("link", None, "href", ("rel", "*", "icon"), BINARY),
    ("link", None, "href", ("rel", "*", "preload"), BINARY),
    ("*", "svg", "xlink:href", None, BINARY),
    ("*", "svg", "href", None, BINARY),
    ("source", "picture", "srcset", None, BINARY),
    ("meta", None, "content", ("property", "=", "og:image"), BINARY),
    ("meta", None, "content", ("property", "=", "og:image:url"), BINARY),
    ("meta", None, "content", ("property", "=", "og:image:secure_url"), BINARY),
    ("meta", None, "content", ("property", "=", "og:audio"), BINARY),
    ("meta", None, "content", ("property", "=", "og:audio:url"), BINARY),
    ("meta", None, "content", ("property", "=", "og:audio:secure_url"), BINARY),
    ("meta", None, "content", ("property", "=", "og:video"), BINARY),
    ("meta", None, "content", ("property", "=", "og:video:url"), BINARY),
    ("meta", None, "content", ("property", "=", "og:video:secure_url"), BINARY),
    ("video", None, "src", None, BINARY),
    ("video", None, "poster", None, BINARY),
    ("source", "video", "src", None, BINARY),
    ("track", "video", "src", None, BINARY),
    ("audio", None, "src", None, BINARY),
    ("source", "audio", "src", None, BINARY),
    ("track", "audio", "src", None, BINARY),
    ("frame", None, "src", None, HTML),
    ("iframe", None, "src", None, HTML),
    ("a", None, "href", None, HTML),
    ("*", None, "background", None, BINARY),
]

# Comments that announce a source map.
SOURCE_MAP_PREFIXES = ("//# sourceMappingURL=", "//@ sourceMappingURL=", "/*# sourceMappingURL=")
# Characters of a source map's URL: RFC 3986 without * and %.
URI_CHARS = r"A-Za-z0-9\-_.~!#$&'()+,/:;=?@\[\]"

# Errors after which a request may be tried again.
RETRY_CODES = "ETIMEDOUT ECONNRESET EADDRINUSE ECONNREFUSED EPIPE ENOTFOUND ENETUNREACH EAI_AGAIN ERR_STREAM_PREMATURE_CLOSE ESERVFAIL".split()
