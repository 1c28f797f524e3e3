"""Host lists, host scores and known policy addresses."""

# These lists must stay as they are for results to agree.

BLOCKED_DOMAINS = (
    "linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "tiktok.com",
    "youtube.com", "pinterest.com", "reddit.com", "tumblr.com", "snapchat.com", "threads.net",
    "mastodon.social", "bsky.app", "yelp.com", "yellowpages.com", "bbb.org", "trustpilot.com",
    "glassdoor.com", "indeed.com", "crunchbase.com", "zoominfo.com", "dnb.com", "hoovers.com",
    "manta.com", "buzzfile.com", "corporationwiki.com", "opencorporates.com",
    "companieshouse.gov.uk", "wikipedia.org", "wikimedia.org", "wikidata.org", "britannica.com",
    "bloomberg.com", "reuters.com", "forbes.com", "businessinsider.com", "ft.com", "wsj.com",
    "nytimes.com", "theguardian.com", "bbc.com", "bbc.co.uk", "cnn.com", "cnbc.com",
    "marketwatch.com", "google.com", "google.de", "google.co.uk", "google.fr", "google.es",
    "google.it", "bing.com", "yahoo.com", "duckduckgo.com", "baidu.com", "yandex.ru", "yandex.com",
    "github.com", "gitlab.com", "bitbucket.org", "sourceforge.net", "npmjs.com", "pypi.org",
    "packagist.org", "rubygems.org", "crates.io", "nuget.org", "hub.docker.com", "apps.apple.com",
    "play.google.com", "microsoft.com/store", "store.steampowered.com", "amazon.com/dp",
    "monster.com", "ziprecruiter.com", "careerbuilder.com", "simplyhired.com", "dice.com",
    "hired.com", "angellist.com", "wellfound.com", "finance.yahoo.com", "seekingalpha.com",
    "morningstar.com", "fool.com", "investopedia.com", "stocktwits.com", "tradingview.com",
    "godaddy.com", "namecheap.com", "cloudflare.com", "domains.google", "hover.com", "name.com",
    "dynadot.com", "wordpress.com", "blogger.com", "medium.com", "substack.com", "squarespace.com",
    "wix.com", "weebly.com", "shopify.com", "bigcommerce.com", "woocommerce.com", "bit.ly",
    "tinyurl.com", "t.co", "goo.gl", "ow.ly", "rebrand.ly", "is.gd", "mail.google.com",
    "outlook.live.com", "mail.yahoo.com", "archive.org", "web.archive.org", "similarweb.com",
    "alexa.com", "semrush.com", "ahrefs.com", "firmenwissen.de", "northdata.de",
    "bundesanzeiger.de", "unternehmensregister.de", "handelsregister.de", "gelbeseiten.de",
    "meinestadt.de", "11880.com", "wlw.de", "kompass.com", "europages.com", "dnb.com",
    "duedil.com", "endole.co.uk", "companieslist.co.uk",
)

BLOCKED_URL_PATTERNS = (
    r"(?i)linkedin\.com/company/", r"(?i)linkedin\.com/in/",
    r"(?i)facebook\.com/.*/(?!privacy|policy|legal)",
    r"(?i)twitter\.com/(?!.*privacy|.*policy|.*tos)", r"(?i)instagram\.com/(?!.*privacy|.*policy)",
    r"(?i)google\.[a-z]+/search", r"(?i)bing\.com/search", r"(?i)duckduckgo\.com/\?q=",
    r"(?i)wikipedia\.org/wiki/(?!Privacy|Terms|Legal)", r"(?i)bloomberg\.com/profile/",
    r"(?i)reuters\.com/companies/", r"(?i)forbes\.com/companies/",
    r"(?i)crunchbase\.com/organization/", r"(?i)glassdoor\.[a-z]+/Overview/",
    r"(?i)indeed\.com/cmp/", r"(?i)yelp\.[a-z]+/biz/", r"(?i)web\.archive\.org/web/",
    r"(?i)archive\.org/details/",
)

RELATED_DOMAINS = {
    "meta.com": ("facebook.com", "instagram.com", "whatsapp.com", "threads.net", "oculus.com",),
    "facebook.com": ("meta.com", "instagram.com", "whatsapp.com", "threads.net",),
    "instagram.com": ("meta.com", "facebook.com",),
    "whatsapp.com": ("meta.com", "facebook.com",),
    "google.com": ("youtube.com", "alphabet.com", "blogger.com", "google.de", "google.co.uk",),
    "youtube.com": ("google.com", "alphabet.com",),
    "alphabet.com": ("google.com", "youtube.com",),
    "microsoft.com": ("linkedin.com", "github.com", "xbox.com", "azure.com", "bing.com", "live.com", "outlook.com",),
    "amazon.com": ("aws.amazon.com", "twitch.tv", "imdb.com", "whole foods.com", "ring.com",),
    "twitch.tv": ("amazon.com",),
    "apple.com": ("icloud.com", "me.com", "apple.de", "apple.co.uk",),
    "twitter.com": ("x.com",),
    "x.com": ("twitter.com",),
    "valve.com": ("steampowered.com", "steamcommunity.com",),
    "steampowered.com": ("valve.com", "steamcommunity.com",),
}

TLD_SCORES = (
    (".com", 10),
    (".de", 10),
    (".co.uk", 10),
    (".org", 8),
    (".net", 5),
    (".io", 3),
    (".app", 3),
    (".bank", 15),
    (".insurance", 15),
    (".gov", 20),
    (".edu", 15),
)

AUTH_MARKERS = (
    "/login", "/signin", "/sign-in", "/authenticate", "/auth/", "accounts.google.com", "/oauth",
    "/sso/", "login.php", "?next=", "returnUrl=", "redirect_uri=", "/challenge/", "/checkpoint/",
)

# (domain, policy type, address)
SPECIAL_POLICY_URLS = (
    ("facebook.com", "privacy",
     "https://www.facebook.com/privacy/policy/"),
    ("facebook.com", "terms",
     "https://www.facebook.com/legal/terms"),
    ("www.facebook.com", "privacy",
     "https://www.facebook.com/privacy/policy/"),
    ("www.facebook.com", "terms",
     "https://www.facebook.com/legal/terms"),
    ("meta.com", "privacy",
     "https://www.facebook.com/privacy/policy/"),
    ("instagram.com", "privacy",
     "https://privacycenter.instagram.com/policy"),
    ("instagram.com", "terms",
     "https://help.instagram.com/581066165581870"),
    ("threads.net", "privacy",
     "https://help.instagram.com/515230437301944"),
    ("whatsapp.com", "privacy",
     "https://www.whatsapp.com/legal/privacy-policy"),
    ("whatsapp.com", "terms",
     "https://www.whatsapp.com/legal/terms-of-service"),
    ("twitter.com", "privacy",
     "https://twitter.com/en/privacy"),
    ("twitter.com", "terms",
     "https://twitter.com/en/tos"),
    ("x.com", "privacy",
     "https://x.com/en/privacy"),
    ("x.com", "terms",
     "https://x.com/en/tos"),
    ("tiktok.com", "privacy",
     "https://www.tiktok.com/legal/page/row/privacy-policy/en"),
    ("tiktok.com", "terms",
     "https://www.tiktok.com/legal/page/row/terms-of-service/en"),
    ("google.com", "privacy",
     "https://policies.google.com/privacy"),
    ("google.com", "terms",
     "https://policies.google.com/terms"),
    ("youtube.com", "privacy",
     "https://policies.google.com/privacy"),
    ("youtube.com", "terms",
     "https://www.youtube.com/static?template=terms"),
    ("linkedin.com", "privacy",
     "https://www.linkedin.com/legal/privacy-policy"),
    ("linkedin.com", "terms",
     "https://www.linkedin.com/legal/user-agreement"),
    ("amazon.com", "privacy",
     "https://www.amazon.com/gp/help/customer/display.html?nodeId=468496"),
    ("amazon.com", "terms",
     "https://www.amazon.com/gp/help/customer/display.html?nodeId=508088"),
    ("microsoft.com", "privacy",
     "https://privacy.microsoft.com/en-us/privacystatement"),
    ("microsoft.com", "terms",
     "https://www.microsoft.com/en-us/servicesagreement"),
    ("apple.com", "privacy",
     "https://www.apple.com/legal/privacy/"),
    ("apple.com", "terms",
     "https://www.apple.com/legal/internet-services/terms/site.html"),
    ("ebay.com", "privacy",
     "https://www.ebay.com/help/policies/member-behaviour-policies/user-privacy-notice-privacy-policy?id=4260"),
    ("ebay.com", "terms",
     "https://www.ebay.com/help/policies/member-behaviour-policies/user-agreement?id=4259"),
    ("www.ebay.com", "privacy",
     "https://www.ebay.com/help/policies/member-behaviour-policies/user-privacy-notice-privacy-policy?id=4260"),
    ("www.ebay.com", "terms",
     "https://www.ebay.com/help/policies/member-behaviour-policies/user-agreement?id=4259"),
    ("paypal.com", "privacy",
     "https://www.paypal.com/us/legalhub/privacy-full"),
    ("paypal.com", "terms",
     "https://www.paypal.com/us/legalhub/useragreement-full"),
    ("www.paypal.com", "privacy",
     "https://www.paypal.com/us/legalhub/privacy-full"),
    ("www.paypal.com", "terms",
     "https://www.paypal.com/us/legalhub/useragreement-full"),
    ("netflix.com", "privacy",
     "https://help.netflix.com/legal/privacy"),
    ("netflix.com", "terms",
     "https://help.netflix.com/legal/termsofuse"),
    ("www.netflix.com", "privacy",
     "https://help.netflix.com/legal/privacy"),
    ("www.netflix.com", "terms",
     "https://help.netflix.com/legal/termsofuse"),
    ("spotify.com", "privacy",
     "https://www.spotify.com/us/legal/privacy-policy/"),
    ("spotify.com", "terms",
     "https://www.spotify.com/us/legal/end-user-agreement/"),
    ("spotify.com", "cookies",
     "https://www.spotify.com/us/legal/cookies-policy/"),
    ("spotify.com", "acceptable_use",
     "https://www.spotify.com/us/legal/user-guidelines/"),
    ("www.spotify.com", "privacy",
     "https://www.spotify.com/us/legal/privacy-policy/"),
    ("www.spotify.com", "terms",
     "https://www.spotify.com/us/legal/end-user-agreement/"),
    ("www.spotify.com", "cookies",
     "https://www.spotify.com/us/legal/cookies-policy/"),
    ("www.spotify.com", "acceptable_use",
     "https://www.spotify.com/us/legal/user-guidelines/"),
    ("discord.com", "privacy",
     "https://discord.com/privacy"),
    ("discord.com", "terms",
     "https://discord.com/terms"),
    ("reddit.com", "privacy",
     "https://www.reddit.com/policies/privacy-policy"),
    ("reddit.com", "terms",
     "https://www.redditinc.com/policies/user-agreement"),
    ("www.reddit.com", "privacy",
     "https://www.reddit.com/policies/privacy-policy"),
    ("www.reddit.com", "terms",
     "https://www.redditinc.com/policies/user-agreement"),
    ("twitch.tv", "privacy",
     "https://www.twitch.tv/p/legal/privacy-notice/"),
    ("twitch.tv", "terms",
     "https://www.twitch.tv/p/legal/terms-of-service/"),
    ("www.twitch.tv", "privacy",
     "https://www.twitch.tv/p/legal/privacy-notice/"),
    ("www.twitch.tv", "terms",
     "https://www.twitch.tv/p/legal/terms-of-service/"),
    ("openai.com", "privacy",
     "https://openai.com/policies/privacy-policy"),
    ("openai.com", "terms",
     "https://openai.com/policies/terms-of-use"),
    ("www.openai.com", "privacy",
     "https://openai.com/policies/privacy-policy"),
    ("www.openai.com", "terms",
     "https://openai.com/policies/terms-of-use"),
    ("zoom.us", "privacy",
     "https://explore.zoom.us/en/privacy/"),
    ("zoom.us", "terms",
     "https://explore.zoom.us/en/terms/"),
    ("dropbox.com", "privacy",
     "https://www.dropbox.com/privacy"),
    ("dropbox.com", "terms",
     "https://www.dropbox.com/terms"),
    ("uber.com", "privacy",
     "https://www.uber.com/legal/en/document/?name=privacy-notice"),
    ("uber.com", "terms",
     "https://www.uber.com/legal/en/document/?name=general-terms-of-use"),
    ("airbnb.com", "privacy",
     "https://www.airbnb.com/help/article/2855"),
    ("airbnb.com", "terms",
     "https://www.airbnb.com/help/article/2908"),
    ("www.airbnb.com", "privacy",
     "https://www.airbnb.com/help/article/2855"),
    ("www.airbnb.com", "terms",
     "https://www.airbnb.com/help/article/2908"),
    ("steampowered.com", "privacy",
     "https://store.steampowered.com/privacy_agreement/"),
    ("steampowered.com", "terms",
     "https://store.steampowered.com/subscriber_agreement/"),
    ("steampowered.com", "cookies",
     "https://store.steampowered.com/legal/"),
    ("store.steampowered.com", "privacy",
     "https://store.steampowered.com/privacy_agreement/"),
    ("store.steampowered.com", "terms",
     "https://store.steampowered.com/subscriber_agreement/"),
    ("store.steampowered.com", "cookies",
     "https://store.steampowered.com/legal/"),
    ("www.steampowered.com", "privacy",
     "https://store.steampowered.com/privacy_agreement/"),
    ("www.steampowered.com", "terms",
     "https://store.steampowered.com/subscriber_agreement/"),
    ("www.steampowered.com", "cookies",
     "https://store.steampowered.com/legal/"),
    ("steamcommunity.com", "privacy",
     "https://store.steampowered.com/privacy_agreement/"),
    ("steamcommunity.com", "terms",
     "https://store.steampowered.com/subscriber_agreement/"),
    ("berenberg.de", "privacy",
     "https://www.berenberg.de/datenschutz/datenschutzerklaerung/"),
    ("www.berenberg.de", "privacy",
     "https://www.berenberg.de/datenschutz/datenschutzerklaerung/"),
    ("deutsche-bank.de", "privacy",
     "https://www.deutsche-bank.de/pk/footer/datenschutzhinweise.html"),
    ("commerzbank.de", "privacy",
     "https://www.commerzbank.de/de/footer/datenschutz.html"),
    ("iphh.net", "privacy",
     "https://www.iphh.net/de/datenschutz.html"),
    ("www.iphh.net", "privacy",
     "https://www.iphh.net/de/datenschutz.html"),
    ("bhphotovideo.com", "privacy",
     "https://www.bhphotovideo.com/find/HelpCenter/Policies.jsp#privacySecurity"),
    ("bhphotovideo.com", "terms",
     "https://www.bhphotovideo.com/find/HelpCenter/Policies.jsp"),
    ("bhphotovideo.com", "cookies",
     "https://www.bhphotovideo.com/find/HelpCenter/Policies.jsp#cookiesNotice"),
    ("www.bhphotovideo.com", "privacy",
     "https://www.bhphotovideo.com/find/HelpCenter/Policies.jsp#privacySecurity"),
    ("www.bhphotovideo.com", "terms",
     "https://www.bhphotovideo.com/find/HelpCenter/Policies.jsp"),
    ("www.bhphotovideo.com", "cookies",
     "https://www.bhphotovideo.com/find/HelpCenter/Policies.jsp#cookiesNotice"),
    ("mi.com", "privacy",
     "https://privacy.mi.com/all/en_US/"),
    ("www.mi.com", "privacy",
     "https://privacy.mi.com/all/en_US/"),
)
