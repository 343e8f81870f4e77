"""Word lists, patterns, tables and limits that results depend on.  Nothing here is logic."""

from __future__ import annotations

# --- URL canonicalisation -------------------------------------------------------------------------------------------
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "fbclid", "gclid", "mc_cid", "mc_eid", "source", "ito", "_ga", "mbid", "cmpid", "ns_mchannel", "ns_campaign"]
CLASSIFIER_TRACKING_PARAMS = TRACKING_PARAMS[:10]
AMP_URL = r"(?i)/amp/|[?&]amp=1|\.amp\.html$|/amp$"
PRINT_URL = r"(?i)/print(/|$)|[?&]print=1|/printable/"
MOBILE_URL = r"(?i)^https?://(m|mobile)\."
SKIP_LINK_PREFIXES = ["mailto:", "javascript:", "tel:", "ftp:", "#"]
SKIP_LINK_EXTENSIONS = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|bmp|ico|doc|docx|xls|xlsx|ppt|pptx|zip|tar|gz|rar|mp3|mp4|avi|mov|wmv|flv|ogg|wav|woff|woff2|ttf|eot|css|js|xml|rss|atom|tsv)(\?.*)?$"

# --- crawler traps --------------------------------------------------------------------------------------------------
TRAP_PARAM = r"(?i)(sort|order|filter|facet|view|display|format|type|tab|ref|sid|session|token|key|hash|nonce|timestamp|ts|_=|cb=|rand|cachebuster)"
TRAP_CALENDAR = r"(?i)/\d{4}/\d{2}/(\d{2}/)?$|/archive/\d{4}|/\d{4}/$"
TRAP_PAGE_PARAM = r"(?i)[?&](page|p|pg|paged|start|offset|from|skip)=(\d+)"
TRAP_PAGE_PATH = [r"(?i)/page/(\d+)", r"(?i)/p/(\d+)"]
TRAP_SEARCH = r"(?i)[?&](q|s|search|query|keyword|k|term|text)="
TRAP_SCROLL = r"(?i)/(load-more|infinite|next-page|ajax|api/posts|feed\.json)"
TRAP_COMMENT = r"(?i)[?&]comment[_-]?page=|#comment|/comment[s]?/page/"
MAX_PATH_DEPTH, MAX_PAGE_NUMBER, MAX_QUERY_PARAMS, MAX_CRAWL_DEPTH = 10, 30, 8, 10

# --- source trust: domain -> (score, category, tier) ----------------------------------------------------------------
TRUST_TIERS = [
    ("sec.gov", 1.00, "regulatory", 1), ("edgar.sec.gov", 1.00, "regulatory", 1), ("irs.gov", 0.98, "regulatory", 1), ("federalreserve.gov", 0.98, "regulatory", 1), ("treasury.gov", 0.97, "regulatory", 1),
    ("bls.gov", 0.97, "regulatory", 1), ("bea.gov", 0.96, "regulatory", 1), ("fdic.gov", 0.96, "regulatory", 1), ("finra.org", 0.95, "regulatory", 1), ("nyse.com", 0.94, "exchange", 1),
    ("nasdaq.com", 0.93, "exchange", 1), ("cmegroup.com", 0.92, "exchange", 1), ("imf.org", 0.95, "regulatory", 1), ("worldbank.org", 0.94, "regulatory", 1), ("bis.org", 0.94, "regulatory", 1),
    ("bloomberg.com", 0.92, "financial_media", 2), ("reuters.com", 0.91, "financial_media", 2), ("wsj.com", 0.90, "financial_media", 2), ("ft.com", 0.90, "financial_media", 2), ("barrons.com", 0.88, "financial_media", 2),
    ("economist.com", 0.88, "financial_media", 2), ("businessinsider.com", 0.82, "financial_media", 2), ("fortune.com", 0.82, "financial_media", 2), ("forbes.com", 0.80, "financial_media", 2),
    ("morningstar.com", 0.87, "financial_analysis", 2), ("seekingalpha.com", 0.78, "financial_analysis", 2), ("zacks.com", 0.77, "financial_analysis", 2), ("thestreet.com", 0.76, "financial_media", 2),
    ("cnbc.com", 0.74, "financial_media", 3), ("marketwatch.com", 0.73, "financial_media", 3), ("investopedia.com", 0.72, "educational", 3), ("bankrate.com", 0.70, "financial_media", 3), ("nerdwallet.com", 0.69, "financial_media", 3),
    ("kiplinger.com", 0.68, "financial_media", 3), ("fool.com", 0.67, "financial_analysis", 3), ("yahoofinance.com", 0.66, "financial_media", 3), ("finance.yahoo.com", 0.66, "financial_media", 3), ("apnews.com", 0.75, "news", 3),
    ("bbc.com", 0.74, "news", 3), ("nytimes.com", 0.74, "news", 3), ("washingtonpost.com", 0.73, "news", 3), ("theguardian.com", 0.72, "news", 3), ("axios.com", 0.70, "news", 3), ("politico.com", 0.70, "news", 3),
    ("techcrunch.com", 0.62, "tech_news", 4), ("arstechnica.com", 0.62, "tech_news", 4), ("wired.com", 0.61, "tech_news", 4), ("venturebeat.com", 0.59, "tech_news", 4), ("theatlantic.com", 0.60, "news", 4),
    ("vox.com", 0.59, "news", 4), ("brookings.edu", 0.65, "research", 4), ("hbr.org", 0.64, "research", 4), ("realpython.com", 0.58, "educational", 4), ("medium.com", 0.45, "blog", 4),
]
INVESTOR_PATHS = r"(?i)/investor-?relations?/|/ir/|/earnings?/|/annual-?report/|/press-?release/|/newsroom/|/about/news"
DEFAULT_TRUST = (0.30, "unknown", 5)
TIER_LABELS = {1: "PRIMARY SOURCE", 2: "MAJOR MEDIA", 3: "ESTABLISHED", 4: "QUALITY NEWS", 5: "GENERAL"}
FINANCIAL_CATEGORIES = ["regulatory", "exchange", "financial_media", "financial_analysis", "investor_relations"]

# --- research queries -----------------------------------------------------------------------------------------------
TICKERS = {
    "apple": "AAPL", "microsoft": "MSFT", "google": "GOOGL", "alphabet": "GOOGL", "amazon": "AMZN", "meta": "META", "facebook": "META", "tesla": "TSLA", "nvidia": "NVDA", "netflix": "NFLX", "berkshire": "BRK", "jpmorgan": "JPM",
    "goldman": "GS", "morgan stanley": "MS", "bank of america": "BAC", "visa": "V", "mastercard": "MA", "paypal": "PYPL", "johnson": "JNJ", "pfizer": "PFE", "unitedhealth": "UNH", "walmart": "WMT", "target": "TGT", "costco": "COST",
    "exxon": "XOM", "chevron": "CVX", "shell": "SHEL", "boeing": "BA", "airbus": "AIR", "lockheed": "LMT", "bitcoin": "BTC", "ethereum": "ETH", "crypto": None, "fed": None, "federal reserve": None, "interest rate": None,
    "inflation": None, "gdp": None, "unemployment": None, "oil": None, "gold": None, "silver": None, "s&p 500": None, "nasdaq": None, "dow jones": None, "openai": None, "anthropic": None, "spacex": None,
}
BULLISH = ["rally", "surge", "gain", "jump", "rise", "soar", "beat", "exceed", "growth", "record", "high", "upgrade", "buy", "outperform", "bullish", "opportunity", "profit", "revenue", "earnings beat", "strong", "positive", "upside", "accelerate", "momentum", "recovery"]
BEARISH = ["fall", "drop", "decline", "plunge", "crash", "loss", "miss", "below", "downgrade", "sell", "underperform", "bearish", "risk", "concern", "weak", "negative", "downside", "slowdown", "recession", "layoff", "cut", "warning", "investigation", "lawsuit", "fine", "penalty"]
SIGNALS = [
    (r"\$[\d,]+\.?\d*\s*(billion|million|trillion)", "financial_figure"), (r"[\d.]+%\s*(increase|decrease|growth|decline|rise|fall)", "percentage_change"), (r"(revenue|earnings|profit|loss)\s+of\s+\$[\d,]+", "earnings_figure"),
    (r"(guidance|forecast|outlook|target|estimate)", "forward_looking"), (r"(merger|acquisition|deal|buyout|takeover)", "corporate_action"), (r"(layoff|restructuring|reorganization|spinoff)", "corporate_action"),
    (r"(dividend|buyback|share repurchase)", "capital_return"), (r"(interest rate|fed rate|federal reserve|monetary policy)", "macro"), (r"(inflation|cpi|pce|employment|jobs report)", "macro"),
    (r"(upgrade|downgrade|price target|analyst)", "analyst_action"), (r"(ipo|listing|public offering|direct listing)", "corporate_action"), (r"(sec|investigation|probe|lawsuit|settlement|fine)", "regulatory"),
]
QUERY_EXPANSIONS = {"stock": ["stock price", "stock analysis"], "fed": ["federal reserve", "fed rate decision"], "inflation": ["inflation rate", "CPI"], "gdp": ["gross domestic product"], "ipo": ["initial public offering"], "earnings": ["earnings report", "quarterly results"], "crypto": ["cryptocurrency", "bitcoin"], "tax": ["tax filing", "tax rates"]}
QUERY_NOISE = ["news", "latest", "update", "2026", "2025", "the", "and", "with", "what", "how"]
RSS_FEEDS = [
    ("https://apnews.com/index.rss", "ap_news_top"), ("https://apnews.com/hub/business.rss", "ap_business"), ("https://apnews.com/hub/financial-markets.rss", "ap_markets"), ("https://apnews.com/hub/economy.rss", "ap_economy"),
    ("https://apnews.com/hub/technology.rss", "ap_tech"), ("https://feeds.npr.org/1006/rss.xml", "npr_business"), ("https://search.cnbc.com/rs/search/combinedcms/view.xml?partnerId=wrss01&id=100003114", "cnbc_top"),
    ("https://feeds.reuters.com/reuters/businessNews", "reuters_business"), ("https://feeds.marketwatch.com/marketwatch/topstories/", "marketwatch_top"),
    ("https://www.sec.gov/cgi-bin/browse-edgar?action=getcurrent&type=8-K&company=&dateb=&owner=include&count=40&output=atom", "sec_8k"),
]
ALWAYS_ON_FEED = "sec_8k"
#: (keywords, [(url, priority)]); no keywords: always.
SEEDS = [
    ([], [("https://www.investopedia.com/investing-4427685", 0.95), ("https://www.investopedia.com/", 0.88), ("https://apnews.com/hub/financial-markets", 0.84), ("https://apnews.com/hub/business", 0.82), ("https://apnews.com/hub/economy", 0.82)]),
    (["rate", "fed", "federal reserve", "interest", "monetary", "fomc"], [("https://www.investopedia.com/terms/f/federalfundsrate.asp", 0.92), ("https://www.investopedia.com/terms/i/interestrate.asp", 0.90), ("https://www.investopedia.com/terms/m/monetarypolicy.asp", 0.88)]),
    (["inflation", "cpi", "pce", "consumer price"], [("https://www.investopedia.com/terms/i/inflation.asp", 0.92), ("https://www.investopedia.com/terms/c/consumerpriceindex.asp", 0.90)]),
    (["gdp", "growth", "recession", "economy", "economic"], [("https://www.investopedia.com/terms/g/gdp.asp", 0.92), ("https://www.investopedia.com/terms/r/recession.asp", 0.90)]),
    (["stock", "equity", "s&p", "nasdaq", "dow", "market"], [("https://www.investopedia.com/terms/s/stockmarket.asp", 0.90), ("https://www.investopedia.com/terms/p/price-earningsratio.asp", 0.88)]),
    (["bitcoin", "crypto", "ethereum", "btc", "defi", "blockchain"], [("https://www.investopedia.com/terms/b/bitcoin.asp", 0.90), ("https://www.investopedia.com/terms/c/cryptocurrency.asp", 0.88), ("https://apnews.com/hub/cryptocurrency", 0.78)]),
    (["tax", "irs", "deduction", "401k", "hsa", "roth", "filing"], [("https://www.investopedia.com/terms/t/taxdeferred.asp", 0.92), ("https://www.investopedia.com/terms/r/rothira.asp", 0.90), ("https://www.investopedia.com/terms/1/401kplan.asp", 0.90)]),
    (["ipo", "public offering", "listing", "spac", "direct listing"], [("https://www.investopedia.com/terms/i/ipo.asp", 0.92)]),
    (["earnings", "results", "revenue", "profit", "quarterly"], [("https://www.investopedia.com/terms/e/earnings.asp", 0.92), ("https://www.investopedia.com/terms/e/eps.asp", 0.88)]),
    (["bond", "yield", "treasury", "fixed income", "debt"], [("https://www.investopedia.com/terms/b/bond.asp", 0.92), ("https://www.investopedia.com/terms/y/yield.asp", 0.88)]),
    (["mortgage", "housing", "real estate", "home loan", "refinanc"], [("https://www.investopedia.com/terms/m/mortgage.asp", 0.92), ("https://www.investopedia.com/terms/r/refinance.asp", 0.88)]),
    (["oil", "energy", "gas", "commodity", "commodities"], [("https://www.investopedia.com/terms/c/commodity.asp", 0.88), ("https://apnews.com/hub/energy-industry", 0.78)]),
    (["ai", "artificial intelligence", "tech", "technology", "chip", "nvidia", "openai"], [("https://apnews.com/hub/artificial-intelligence", 0.80), ("https://www.investopedia.com/terms/a/artificial-intelligence.asp", 0.88)]),
    (["retire", "pension", "social security", "retirement"], [("https://www.investopedia.com/terms/r/retirement.asp", 0.90), ("https://www.investopedia.com/terms/p/pensionplan.asp", 0.88)]),
    (["insurance", "health", "life insurance", "premium"], [("https://www.investopedia.com/terms/l/lifeinsurance.asp", 0.90)]),
    (["bank", "banking", "credit", "loan", "deposit", "cd rates", "savings"], [("https://www.investopedia.com/terms/b/bank.asp", 0.88), ("https://www.investopedia.com/terms/c/certificateofdeposit.asp", 0.88)]),
]

# --- stop words -----------------------------------------------------------------------------------------------------
#: Words that the term counts of the report pass over.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "that", "this", "was", "are", "be",
    "has", "had", "have", "not", "they", "we", "you", "he", "she", "its", "as", "which", "their", "will", "can", "would", "could", "been", "said",
    "than", "more", "also", "were", "about", "into", "all", "one", "two", "new", "other", "may", "who", "what", "when", "where", "how", "if", "do",
    "did", "does", "just", "over", "such", "like", "most", "some", "very", "much", "only", "so", "no", "up", "out", "any", "each", "use", "used",
    "using", "get", "make", "made", "need", "want", "add", "your", "our", "there", "here", "then", "now", "time", "way", "well", "even", "back", "first",
    "last", "long", "great", "little", "good", "take", "see", "know", "think", "look", "come", "going",
]
#: Words that the ranking passes over, in several languages.
RANKING_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "that", "this", "was", "are", "be",
    "has", "had", "have", "not", "they", "we", "you", "he", "she", "its", "as", "which", "their", "will", "can", "would", "could", "been", "said",
    "than", "more", "also", "were", "about", "into", "all", "one", "two", "new", "other", "may", "who", "what", "when", "where", "how", "if", "do",
    "did", "does", "just", "over", "such", "like", "most", "some", "very", "much", "only", "so", "no", "up", "out", "any", "each", "use", "used",
    "using", "get", "make", "made", "need", "want", "your", "our", "there", "here", "then", "now", "time", "way", "well", "even", "back", "first",
    "last", "long", "great", "good", "take", "see", "know", "think", "el", "la", "de", "y", "en", "los", "las", "un", "una", "es", "por", "con", "para",
    "le", "les", "des", "du", "au", "aux", "est", "pour", "avec", "dans", "sur", "par", "ce", "der", "die", "das", "den", "und", "ist", "mit", "von",
    "für", "auf", "ein", "eine",
]

# --- page classification --------------------------------------------------------------------------------------------
NOISE_PATH = r"(?i)^/?(tag|tags|category|categories|author|authors|search|login|signin|signup|register|cart|checkout|account|profile|settings|admin|wp-admin|feed|rss|sitemap|robots\.txt|privacy|terms|contact|about|newsletter|subscribe|advertise|jobs|careers|press|media|legal|cookie|gdpr|page/\d+$|archive/\d{4}/\d{2}/page|/\?s=|/\?q=|/\?search=)"
COMMENT_PATH = r"(?i)/(comments?|replies|discuss|forum|thread|respond)(s?/|$)"
NEWS_PATH = r"(?i)/(news|article|articles|story|stories|breaking|report|reports|press-release)/"
BLOG_PATH = r"(?i)/(blog|post|posts|entry|entries|journal|diary|dispatch|update|updates)(/[^/]+)?/?$|medium\.com/[^/]+/[a-z0-9-]{10,}"
WIKI_PATH = r"(?i)(/wiki/|/w/index|wikipedia\.org/wiki)"
DOCS_PATH = r"(?i)/(docs|documentation|guide|guides|tutorial|tutorials|manual|manuals|reference|api-docs|api|library|stdlib|modules?)(/|$)"
EDUCATIONAL_PATH = r"(?i)/(learn|learning|lesson|lessons|course|courses|class|classes|education|module|modules|lecture|lectures|explainer|explainers|study|curriculum|how-to|howto|faq|faqs|glossary|knowledge-base|kb|help)/"
EDUCATIONAL_DOMAIN = r"(?i)(khan|coursera|edx|udemy|skillshare|lynda|pluralsight|wikipedia|britannica|investopedia|edu\.|academy|university|college|school)"
LONGFORM_PATH = r"(?i)/(analysis|analyses|insight|insights|opinion|editorial|essay|feature|features|longread|long-read|deep-dive|explainer|explainers|investigation|research|paper|papers|whitepaper|white-paper|study|studies|perspective|commentary|column|report|reports)/"
LONGFORM_DOMAIN = r"(?i)(brookings|rand\.org|pewresearch|urban\.org|cfr\.org|nber\.org|theatlantic|newyorker|longform\.org|aeon\.co|vox\.com|fivethirtyeight|economist\.com|foreignpolicy|foreignaffairs)"
FINANCIAL_PATH = r"(?i)/(finance|financial|tax|taxes|investing|investment|investments|accounting|fiscal|budget|budgets|earnings|revenue|irs|sec|form|annual-report|quarterly-report|10-k|10-q|8-k|proxy|prospectus|fund|funds|etf|stock|bonds|portfolio|pension|retirement|401k|mortgage|loan|credit|insurance|wealth|asset|liability)/"
FINANCIAL_DOMAIN = r"(?i)(irs\.gov|sec\.gov|investopedia|bloomberg|reuters|ft\.com|wsj\.com|cnbc|marketwatch|morningstar|fool\.com|bankrate|nerdwallet|kiplinger|thestreet|barrons|seeking.alpha|nasdaq|nyse|finra|treasury\.gov)"
CONTENT_PATH = r"(?i)/(news|article|articles|blog|post|posts|story|stories|wiki|docs|documentation|guide|guides|tutorial|tutorials|report|reports|analysis|review|reviews|opinion|editorial|feature|features|learn|education|resource|resources|research|paper|papers|insight|insights|course|lesson|finance|tax|investing|howto|explainer|longread)/"
DATE_PATH = r"/\d{4}/\d{2}(/\d{2})?/"
SLUG = r"^[a-z0-9]+(-[a-z0-9]+){3,}$"
FINANCIAL_URL_WORDS = ["/tax", "/irs", "/form-", "/schedule-", "/10-k", "/10-q", "/annual-report", "/fiscal"]
DOCS_URL_WORDS = ["/docs/", "/documentation/", "/reference/", "/library/", "/stdlib/"]
BLOG_URL_WORDS = ["/blog/", "/post/", "/posts/"]
NEWS_URL_WORDS = ["/news/", "/article/", "/story/"]
ARTICLE_SCHEMAS = ["Article", "NewsArticle", "BlogPosting", "TechArticle", "WebPage", "ScholarlyArticle", "EducationalOccupationalCredential", "Course", "LearningResource"]
FINANCIAL_SCHEMAS = ["FinancialProduct", "FinancialService", "InvestmentFund", "BankAccount", "MoneyTransfer", "LoanOrCredit"]
EDUCATIONAL_SCHEMAS = ["Course", "LearningResource", "EducationalOccupationalCredential"]
FINANCIAL_TITLE = r"(?i)tax|irs|401k|income|revenue|earnings|financial|invest|fund|stock|bond|mortgage|filing|form \d{4}|schedule [a-z]|deduction|dividend"
EDUCATIONAL_TITLE = r"(?i)how to|guide|tutorial|learn|lesson|course|step[- ]by[- ]step|what is|explained|introduction to|beginners|masterclass|overview"
LONGFORM_WORDS = 800
PAGE_TYPES = ["news_article", "blog_post", "wiki_page", "documentation", "educational", "long_form_informational", "financial_tax"]
NAVIGATION_TITLE = r"(?i)^(site map|a.?z index|home|rss feeds?|careers?|contact us?|newsletter|subscribe|privacy|terms of service|about us|faqs?|frequently asked|press releases?|media kit|advertise|accessibility|disclaimer|recent postings|search results?|error|page not found|403|404|sign in|log in|markets|pre.?markets|after.?hours|futures( & commodities)?|funds and etfs|business( news)?|economy|finance|media|health and science|technology|politics|prediction markets|us top news and analysis|world markets|currencies|bonds|watchlist|portfolio|latest news|top stories|breaking news)$"

# --- HTML -----------------------------------------------------------------------------------------------------------
EXTRACT_NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form", "iframe"]
EXTRACT_NOISE_CLASSES = r"(?i)nav|navigation|menu|sidebar|footer|header|breadcrumb|cookie|banner|popup|newsletter|subscribe|social|share|related|recommend|advertisement|ad-|ads|comment|disqus|widget|promo|sponsor|tag-list|category-list|pagination|author-bio|byline-extra|site-footer|site-header"
MARKDOWN_NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript", "svg", "button", "input", "select", "textarea"]
MARKDOWN_BLOCKS = ["div", "section", "article", "main", "figure", "figcaption", "details", "summary", "dl", "dt", "dd", "span", "body"]
JS_MARKERS = [("react", ['id="root"', 'id="app"', "data-reactroot", "_next/static", "__next_data__"]), ("angular", ["ng-version", "ng-app", "angular.min.js"]), ("vue", ['id="app"', "__vue__", "vue.min.js", "nuxt"]), ("svelte", ["__svelte", "svelte-"]), ("ember", ["ember-view", "ember-application"])]
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml", "/wp-sitemap.xml", "/news-sitemap.xml", "/post-sitemap.xml", "/page-sitemap.xml", "/sitemap_news.xml", "/atom.xml"]
SITEMAP_DEPTH = 5

# --- recrawl --------------------------------------------------------------------------------------------------------
MIN_INTERVAL, MAX_INTERVAL, DEFAULT_INTERVAL, INTERVAL_FACTOR = 3600, 604800, 86400, 1.5
CHANGEFREQ = {"always": 1800, "hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000, "yearly": 31536000, "never": 604800}
