"""Row types of the feed and edition tables."""

ITEM = "title string, url string, published_at timestamp, summary string"
CANDIDATE = "id long, pos long, batch date, source string, discovery_only boolean, title string, url string, published_at timestamp, summary string"
FEED_RUN = "feed string, run_at timestamp, ok boolean, n long, error string"
SOURCE = "title string, publisher string, url string, publishedAt timestamp, tier int"
STORY = (
    "id string, slug string, beat string, kicker string, headline string, deck string, summary array<string>, body array<string>, whyItMatters string, prominence string, "
    f"publishedAt timestamp, readMinutes int, confidence string, entities array<string>, tags array<string>, sources array<struct<{SOURCE.replace(' ', ':').replace(',:', ',')}>>"
)
