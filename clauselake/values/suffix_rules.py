"""Public suffixes known without a table, in the notation of the public suffix list.

Fixed values. ``*.x`` makes every label under ``x`` a suffix, ``!a.x`` takes one of them out again. A full list is
an input (``sources.readers.read_public_suffixes``).
"""

REGISTRY_RULES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "police.uk", "*.sch.uk",
    "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.nz", "co.nz", "geek.nz", "govt.nz", "net.nz", "org.nz", "school.nz",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "hokkaido.jp", "kyoto.jp", "osaka.jp", "tokyo.jp",
    "*.kawasaki.jp", "*.kobe.jp", "*.nagoya.jp", "*.sapporo.jp", "*.sendai.jp", "*.yokohama.jp",
    "!city.kawasaki.jp", "!city.kobe.jp", "!city.nagoya.jp", "!city.sapporo.jp", "!city.sendai.jp", "!city.yokohama.jp",
    "com.br", "gov.br", "net.br", "org.br", "com.mx", "org.mx", "com.ar", "com.co", "com.pe", "com.tr", "com.eg", "com.sa",
    "com.cn", "gov.cn", "net.cn", "org.cn", "com.tw", "com.hk", "com.sg", "com.my", "com.ph", "com.vn", "com.pk", "com.ng",
    "ac.in", "co.in", "firm.in", "gen.in", "ind.in", "net.in", "org.in", "co.kr", "or.kr", "co.za", "org.za", "co.il", "org.il",
    "ac.th", "co.th", "in.th", "co.id", "or.id", "web.id", "co.ke", "com.pl", "com.ua", "kiev.ua", "com.gr", "com.pt",
    "ca.us", "cc.ca.us", "k12.ca.us", "lib.ca.us", "ny.us", "k12.ny.us", "tx.us", "k12.tx.us", "fed.us", "isa.us", "nsn.us",
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg",
)

#: Names whose owners give the labels below to strangers.
PRIVATE_RULES = (
    "appspot.com", "azurewebsites.net", "bitbucket.io", "blogspot.com", "cloudfront.net", "duckdns.org", "firebaseapp.com", "fly.dev",
    "github.io", "githubusercontent.com", "gitlab.io", "glitch.me", "herokuapp.com", "myshopify.com", "neocities.org", "netlify.app",
    "ngrok.io", "onrender.com", "pages.dev", "readthedocs.io", "s3.amazonaws.com", "surge.sh", "vercel.app", "web.app", "workers.dev",
    "*.compute.amazonaws.com", "*.elb.amazonaws.com",
)
