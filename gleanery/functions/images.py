"""Column functions on videos and images named in addresses and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Addresses of videos, with the id as the group; thumbnails, best first; meta tags that name an image, in their order; junk in image addresses.
VIDEO_PATTERNS = [r"(?i)youtube\.com/watch\?v=([^&]+)", r"(?i)youtu\.be/([^?]+)", r"(?i)youtube\.com/embed/([^?]+)", r"(?i)youtube\.com/v/([^?]+)"]
THUMBNAILS = ["maxresdefault", "sddefault", "hqdefault", "mqdefault"]
META_IMAGES = [("property", "og:image"), ("property", "og:image:url"), ("name", "og:image"), ("property", "twitter:image"), ("name", "twitter:image"), ("property", "twitter:image:src")]
JUNK = ["icon", "logo", "avatar", "profile", "thumb", "small", "badge", "button", "arrow", "star", "social", "share", "ads?/", "advertisement", "tracking", "analytics", "pixel", "1x1", "spacer"]


def is_video(url: Column) -> Column:
    return url.rlike(r"(?i)youtube\.com/watch|youtu\.be/|youtube\.com/embed/|youtube\.com/v/")


def video_id(url: Column) -> Column:
    """The id in a video's address; null for other addresses."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in VIDEO_PATTERNS])


def thumbnails(video: Column) -> Column:
    """Addresses of a video's thumbnails, best first; null for a null id."""
    return F.when(video.isNotNull(), F.transform(F.array(*map(F.lit, THUMBNAILS)), lambda q: F.concat(F.lit("https://img.youtube.com/vi/"), video, F.lit("/"), q, F.lit(".jpg"))))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; null where it has none or an empty one."""
    return F.nullif(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def meta_image(html: Column) -> Column:
    """The image that a page's meta tags name, by the first kind of tag that has one; null where none has."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), 1)
    tries = []
    for kind, value in META_IMAGES:
        first = F.get(F.filter(tags, lambda t: F.coalesce(attribute(t, kind) == value, F.lit(False))), F.lit(0))  # noqa: B023  called at once
        tries.append(F.coalesce(attribute(first, "content"), attribute(first, "value")))
    return F.coalesce(*tries)


def content_image(src: Column, width: Column, height: Column, junk: Sequence[str] = JUNK) -> Column:
    """Whether an image may show a page's content: not declared smaller than 200 by 150 (both given as numbers), no junk in its address."""
    w, h = width.try_cast("int"), height.try_cast("int")
    small = F.coalesce((w < 200) | (h < 150), F.lit(False)) & w.isNotNull() & h.isNotNull()
    return ~small & ~F.lower(src).rlike("|".join(junk))


def page_image(html: Column) -> Column:
    """The address of the first image of a page that may show its content; null where there is none."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<img\s[^>]*>)"), 1)
    fit = F.filter(tags, lambda t: F.coalesce(content_image(attribute(t, "src"), attribute(t, "width"), attribute(t, "height")), F.lit(False)))
    return attribute(F.get(fit, F.lit(0)), "src")


def chosen_image(url: Column, html: Column) -> Column:
    """The image of a page: a video's best thumbnail, else the one its meta tags name, else the first that fits."""
    return F.coalesce(F.get(thumbnails(video_id(url)), F.lit(0)), meta_image(html), page_image(html))


def valid_image(width: Column, height: Column) -> Column:
    """At least 100 by 100, and from 0.3 to 3 times as wide as high."""
    return (width >= 100) & (height >= 100) & (width / F.greatest(height, F.lit(1))).between(0.3, 3.0)


def fetchable(content_type: Column, size: Column) -> Column:
    """An image of 1000 bytes to 10 MB."""
    return F.startswith(F.lower(content_type), F.lit("image/")) & size.between(1000, 10 * 1024 * 1024)


def image_source(path: Column, url: Column) -> Column:
    return F.when(is_video(url), "youtube").when(path.rlike("og:image|ogp"), "ogp").when(F.contains(path, F.lit("content")), "content").otherwise("unknown")


def resolved(base: Column, link: Column) -> Column:
    """A link of a page as a full address: full ones as they are, others against the scheme, the host or the folder of the page."""
    scheme, host = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(host, link)).otherwise(F.concat(folder, link))
