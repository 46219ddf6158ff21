"""Lists and constants that results depend on."""

# Article pages.
NON_ARTICLE_SEGMENTS = (
    "tag", "tags", "category", "categories", "topic", "topics", "author", "authors", "page", "pages", "search", "archive", "archives",
    "feed", "rss", "atom", "comments", "about", "contact", "privacy", "terms", "login", "signup", "register", "cart", "shop",
)
NON_ARTICLE_EXTENSIONS = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".css", ".js", ".json", ".xml", ".zip", ".gz", ".mp3", ".mp4", ".webm", ".txt",
)
SKIP_ELEMENTS = (
    "script", "style", "nav", "header", "footer", "aside", "form", "button", "noscript", "iframe", "svg", "select", "pre", "code", "figcaption",
)
HIDDEN_CLASS_HINTS = (
    "anchor", "headerlink", "header-link", "heading-link", "permalink", "hash-link", "sr-only", "visually-hidden", "visuallyhidden",
    "screen-reader", "screenreader",
)
PUBLISHED_KEYS = ("article:published_time", "datepublished", "article:published", "date", "dc.date.issued", "dc.date", "pubdate", "publish_date")
TITLE_KEYS = ("og:title", "twitter:title")
UNINFORMATIVE_CATEGORIES = (
    "uncategorized", "uncategorised", "general", "other", "misc", "miscellaneous", "blog", "blogs", "post", "posts", "article", "articles",
    "writing", "all", "featured", "default",
)
TITLE_WORDS, AUTHOR_WORDS, SUMMARY_WORDS, CONTENT_WORDS = 40, 15, 40, 1000
SUMMARY_FLOOR_WORDS, FULL_BODY_WORDS, PAGE_MIN_WORDS = 12, 200, 250
MAX_TOPICS, MAX_CATEGORY_TOPICS = 8, 3

# Sites.
EXCLUDED_HOSTS = (
    "github.com", "www.github.com", "raw.githubusercontent.com", "gist.github.com", "docs.github.com", "api.github.com", "gitlab.com",
    "www.gitlab.com", "bitbucket.org", "sourceforge.net", "npmjs.com", "www.npmjs.com", "pypi.org", "rubygems.org", "crates.io",
    "packagist.org", "hub.docker.com", "marketplace.visualstudio.com", "twitter.com", "x.com", "facebook.com", "www.facebook.com",
    "instagram.com", "www.instagram.com", "linkedin.com", "www.linkedin.com", "youtube.com", "www.youtube.com", "youtu.be", "reddit.com",
    "www.reddit.com", "bsky.app", "mastodon.social", "news.ycombinator.com", "lobste.rs", "t.me", "telegram.me", "discord.gg", "discord.com",
    "slack.com", "threads.net", "pinterest.com", "patreon.com", "www.patreon.com", "ko-fi.com", "buymeacoffee.com", "www.buymeacoffee.com",
    "opencollective.com", "paypal.me", "shields.io", "img.shields.io", "badgen.net", "badge.fury.io", "forthebadge.com", "travis-ci.org",
    "travis-ci.com", "circleci.com", "codecov.io", "coveralls.io", "wikipedia.org", "stackoverflow.com", "stackexchange.com",
    "creativecommons.org", "opensource.org", "choosealicense.com", "unlicense.org", "archive.org", "web.archive.org", "archive.ph", "goo.gl",
    "bit.ly", "t.co", "tinyurl.com", "amazon.com", "www.amazon.com", "play.google.com", "apps.apple.com", "docs.google.com",
    "drive.google.com", "forms.gle", "translate.google.com", "example.com", "www.example.com", "localhost",
)
EXCLUDED_HOST_SUFFIXES = (".githubusercontent.com", ".wikipedia.org", ".stackexchange.com", ".slack.com", ".zoom.us", ".local")
EXCLUDED_HOST_PREFIXES = (
    "cdn.", "static.", "assets.", "img.", "images.", "media.", "status.", "shop.", "store.", "checkout.", "accounts.", "account.", "login.",
    "auth.",
)
RESERVED_TLD_SUFFIXES = (".test", ".invalid", ".internal", ".localhost", ".example")
MULTI_TENANT_HOSTS = (
    "medium.com", "dev.to", "hashnode.com", "substack.com", "hackernoon.com", "qiita.com", "zenn.dev", "note.com", "write.as", "telegra.ph",
    "micro.blog", "blog.csdn.net", "people.kernel.org", "lwn.net",
)
MULTI_TENANT_HOST_SUFFIXES = (".github.io", ".gitlab.io", ".netlify.app", ".vercel.app", ".pages.dev", ".sourceforge.io")
BLOG_PATH_SEGMENTS = (
    "blog", "blogs", "posts", "writing", "writings", "articles", "essays", "notes", "journal", "weblog", "news", "engineering",
    "engineering-blog", "tech", "techblog", "tech-blog", "insights", "thoughts", "devblog", "dev-blog",
)
PATH_NOISE_SEGMENTS = (
    "post", "p", "article", "entry", "archive", "archives", "tag", "tags", "category", "categories", "page", "pages", "about", "search",
    "feed", "rss", "atom", "index", "en", "login", "signup", "assets", "static", "images",
)
NON_PAGE_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg", ".ico", ".pdf", ".zip", ".gz", ".tgz", ".tar", ".7z", ".mp3", ".mp4", ".mov", ".avi",
    ".webm", ".css", ".js", ".map", ".woff", ".woff2", ".ttf", ".exe", ".dmg", ".pkg", ".deb", ".rpm",
)
TRACKING_QUERY_KEYS = ("ref", "source", "fbclid", "gclid", "mc_cid", "mc_eid")
COMMON_FEED_PATHS = ("feed", "feed.xml", "rss", "rss.xml", "atom.xml", "index.xml", "feeds/posts/default?alt=rss")
VISIT_TRACKING = r"^(utm_[a-z]+|mc_[ce]id|fbclid|gclid|igshid|mkt_tok|ref|ref_src)$"
GENERIC_NAMES = (
    "home", "homepage", "index", "welcome", "blog", "my blog", "posts", "articles", "link", "here", "website", "site", "rss", "feed",
    "untitled", "page not found", "404", "read more", "click here", "docs", "documentation", "github", "twitter", "linkedin", "twitch",
    "discord", "discord server", "newsletter", "about",
)
MAX_NAME_LENGTH = 80

# List files.
LIST_FILE_EXTENSIONS = (
    ".md", ".markdown", ".txt", ".rst", ".csv", ".tsv", ".json", ".jsonl", ".yml", ".yaml", ".xml", ".opml", ".html", ".htm",
)
LIST_FILE_STEMS = ("readme", "dataset", "blogs", "blog", "sources", "source", "feeds", "feed", "sites", "urls", "links", "list")
SKIPPED_STEMS = (
    "license", "licence", "copying", "contributing", "code_of_conduct", "code-of-conduct", "changelog", "security", "funding",
    "pull_request_template", "issue_template",
)
STRUCTURED_EXTENSIONS = (".csv", ".tsv", ".json", ".jsonl", ".yml", ".yaml", ".xml", ".opml", ".html", ".htm")

# Search and limits.
FIELD_WEIGHTS = {"title": 4.0, "author": 3.0, "summary": 2.0, "content": 1.0, "topics": 1.0}
PER_SOURCE_CAP, OVERFETCH, SEMANTIC_WINDOW = 3, 3, 50
MAX_LIMIT, DEFAULT_LIMIT, MAX_OFFSET_KEYWORD, MAX_QUERY_CHARS = 50, 20, 1000, 512
LIMITS = {"caller": (60, 30), "service": (600, 300), "semantic_caller": (10, 5), "semantic_service": (1, 15), "log": (6, 3)}
SITEMAP_MAPS, SITEMAP_ENTRIES = 4, 20_000
HISTORY_CAP, HISTORY_KEEP, BOOKMARK_CAP = 250_000, 200_000, 5_000
PERIOD_DAYS = (0, 30, 365, 1825)
MAX_TAGS, MIN_TAG_SCORE, CATEGORY_SCORE = 6, 2, 2
PROVENANCE_TAGS = ("personal-blogs", "company-blogs", "independent-web", "small-web")

# Words of a list's address and the tags they give. All words of a group of a fallback rule's second form must occur.
PROVENANCE_RULES = (
    ("personal-blogs", ("personal", "smallweb", "indieweb", "blogscroll")),
    ("company-blogs", ("company", "companies")),
    ("independent-web", ("independent", "smallweb", "indieweb", "blogscroll")),
    ("small-web", ("independent", "smallweb", "indieweb", "blogscroll")),
)
FALLBACK_RULES = (
    ("software-engineering", ("engineering", "software", "programming", "developer", "dev", "devblogs")),
    ("ai", ("ml", "ai", "llm", "llms", "deeplearning")),
    ("machine-learning", ("ml", "ai", "llm", "llms", "deeplearning")),
    ("web-development", ("frontend", "webdev")),
    ("security", ("security",)),
    ("python", ("python",)),
    ("data-science", (("data", "science"),)),
    ("astronomy", ("astronomy", "astro")),
    ("physics", ("physics",)),
    ("science", ("science",)),
)
FALLBACK_TAG = "tech"
