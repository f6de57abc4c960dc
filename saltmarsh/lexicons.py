"""The word lists and character tables that detection depends on, in their natural order."""

from __future__ import annotations

INTENT_CHANNEL = [
    "whatsapp", "whats app", "whatzapp", "watsapp", "wtsapp", "wsp", "wapp", "green app", "green tick app", "the green one", "telegram", "tele gram",
    "tg", "signal app", "imessage", "viber", "snapchat", "snap chat", "instagram", "insta", "insta gram", "ig", "igdm", "facebook", "fb", "messenger",
    "sms", "text message", "email me", "mail me", "gmail", "linkedin", "linked in", "youtube", "you tube", "tiktok", "tik tok", "discord", "reddit",
    "pinterest", "threads", "bluesky", "wechat", "line", "botim", "imo", "hike", "josh", "moj", "sharechat",
]

INTENT_ACTION = [
    "call me", "call karo", "call kar", "call kro", "phone me", "ring me", "give me a call", "gimme a call", "give a missed call", "missed call",
    "dm me", "dm karo", "text me", "message me", "msg me", "msg karna", "msg kar", "ping me", "buzz me", "reach me at", "reach out at",
    "contact me at", "hit me up", "hmu", "number de do", "number dedo", "number bhejo", "number send karo", "apna number", "mera number",
    "my number is", "number is", "send your number", "share your number", "no. de do", "contact number", "mobile number", "mob no", "cell number",
    "send me your number", "send your number", "send me ur number", "give me your number", "give your number", "share your contact",
    "your number please", "whats your number", "what is your number", "can i have your number", "may i have your number", "drop your number",
    "send me your contact", "send your contact", "send me your details", "send me a message on", "message me on", "send me a link to your profile",
    "your profile link", "add me on", "find me on", "follow me on", "connect with me on", "send me your handle", "whats your handle", "aapka number",
    "number bhej do", "number bhej dijiye", "number share karo", "ur number", "ur numbr", "ur no", "yr number", "your numbr", "whats ur",
    "whts ur number", "wats ur number", "number pls", "number plz", "num pls", "send ur number", "send ur numbr", "give ur number", "share ur number",
    "ill call", "i'll call you", "ill call u", "can i call u", "can i call you", "lemme call", "let me call you", "call u", "call you directly",
]

INTENT_OFFPLATFORM = [
    "book direct", "book directly", "direct booking", "directly book", "take this offline", "offline baat", "offline discuss", "outside the app",
    "outside app", "off the app", "off platform", "without the app", "app ke bahar", "app se bahar", "avoid the fee", "avoid commission",
    "save commission", "no commission", "cheaper direct", "better price direct", "direct me sasta", "cancel here and", "cancel the booking and",
    "cancel and book", "next time direct", "agli baar direct", "seedha book", "contact me directly", "contact me direct", "reach me directly",
    "message me directly", "deal directly", "work directly", "avoid the commission", "avoid the platform", "avoid the app", "skip the app",
    "skip the platform", "bypass the app", "without the platform", "outside the platform", "save the fee", "save the commission", "no platform fee",
    "cut out the middleman", "middleman hata do",
]

INTENT_PAYMENT = [
    "google pay", "gpay", "g pay", "phonepe", "phone pe", "paytm", "bhim", "upi id", "upi karo", "upi kar do", "scan the qr", "qr code",
    "bank transfer", "neft", "imps", "rtgs", "account number", "cash payment", "cash me do", "cash de dena", "pay cash", "advance de do",
    "advance bhejo", "token amount",
]

INTENT_NEGATIVE_CONTEXT = [
    "call it a day", "call it quits", "close call", "call the shots", "wake up call", "on call", "call ahead if", "courtesy call", "judgement call",
    "judgment call", "call center", "call centre", "roll call", "call to prayer", "last call", "text book", "textbook", "book direct flight",
]

MESSENGER_DOMAINS = [
    "wa.me", "api.whatsapp.com", "chat.whatsapp.com", "web.whatsapp.com", "whatsapp.com", "t.me", "telegram.me", "telegram.org", "telegram.dog",
    "ig.me", "instagram.com", "instagr.am", "m.me", "messenger.com", "facebook.com", "fb.com", "fb.me", "signal.me", "snapchat.com", "discord.gg",
    "discord.com", "join.skype.com", "skype.com", "hangouts.google.com", "meet.google.com", "zoom.us", "linkedin.com", "x.com", "twitter.com",
]

SHORTENERS = [
    "bit.ly", "bitly.com", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "buff.ly", "is.gd", "cutt.ly", "rebrand.ly", "shorturl.at", "rb.gy", "linktr.ee",
    "s.id", "tiny.cc", "shorte.st", "adf.ly", "bl.ink", "clck.ru", "v.gd", "qr.ae", "u.to", "sh.st", "surl.li", "shrtco.de", "1link.in", "zi.gg",
]

PAYMENT_DOMAINS = [
    "paypal.me", "razorpay.com", "rzp.io", "pages.razorpay.com", "paytm.me", "phonepe.com", "gpay.app.goo.gl", "cash.app", "venmo.com", "wise.com",
    "revolut.me", "buymeacoffee.com", "stripe.com",
]

RISKY_TLDS = [
    "tk", "ml", "ga", "cf", "gq", "top", "xyz", "buzz", "click", "link", "work", "loan", "download", "review", "country", "stream", "gdn", "mom",
    "party", "science", "date", "faith", "racing", "win", "bid", "trade", "webcam", "cricket", "accountant", "zip", "mov", "rest",
]

EMAIL_DOMAINS = [
    "gmail", "googlemail", "yahoo", "ymail", "rediffmail", "rediff", "hotmail", "outlook", "live", "msn", "icloud", "me", "aol", "protonmail",
    "proton", "zoho", "gmx", "mail", "yandex", "inbox",
]

UPI_PSP_HANDLES = [
    "ybl", "ibl", "axl", "apl", "abfspay", "okhdfcbank", "okicici", "oksbi", "okaxis", "okbizaxis", "paytm", "ptaxis", "ptsbi", "ptyes", "pthdfc",
    "upi", "hdfcbank", "icici", "sbi", "axisbank", "kotak", "yesbank", "indus", "idfcbank", "idfcfirst", "federal", "fbl", "rbl", "unionbank", "uboi",
    "barodampay", "bandhan", "cnrb", "cboi", "dbs", "dlb", "jkb", "kbl", "kvb", "lvb", "pnb", "psb", "purz", "sib", "tjsb", "utbi", "yapl", "airtel",
    "freecharge", "jupiteraxis", "naviaxis", "slc", "timecosmos", "waaxis", "wahdfcbank", "waicici", "wasbi", "amazonpay", "aubank", "goaxb", "jio",
    "mahb", "myicici", "niyoicici", "omni", "rapl", "sliceaxis", "superyes", "yesg", "zoicici", "fam", "fkaxis", "seyes", "trans",
]

HOSTILITY_MILD = [
    "crap", "crappy", "shit", "shitty", "damn", "goddamn", "wtf", "wth", "sucks", "sucked", "bloody hell", "hell no", "bloody",
]

HOSTILITY_SEV1 = [
    "shut up", "shutup", "stupid", "idiot", "nonsense", "rubbish", "pathetic", "worst", "useless", "trash", "garbage", "clown", "joker", "fool",
    "bakwas", "bakwaas", "faltu", "ghatiya", "bewakoof", "pagal", "paagal", "nalayak", "chup kar", "chup ho ja",
]

HOSTILITY_SEV2 = [
    "bastard", "asshole", "arsehole", "dickhead", "scumbag", "moron", "retard", "shithead", "prick", "wanker", "cunt", "bitch", "whore", "kutta",
    "kutte", "kamina", "kamine", "harami", "haramkhor", "gandu", "chutiya", "chutiye", "bhosdi", "bhosdike", "madarchod", "behenchod", "bhenchod",
    "bkl", "saala", "saale", "randi", "fuck", "fucking", "fucker", "fuckers", "fucked", "fuckoff", "fuk", "fuck u", "fck", "fuq", "phuck", "stfu",
    "gtfo", "bullshit", "shithead", "piece of shit", "pos scam", "shit show", "dick", "cock", "twat", "slut", "douche", "douchebag", "jackass",
    "dumbass", "piss off", "screw you", "screw off", "sod off", "bugger off", "lanjha", "lawda", "lauda", "lund", "chodu", "gaandu", "gaand",
    "bhosadi", "bhosadike", "maderchod", "madarjaat", "teri maa", "teri ma", "maa ki", "behen ki", "mkc",
]

HOSTILITY_SEV3 = [
    "kill you", "kill u", "murder you", "stab you", "shoot you", "beat you up", "beat the shit", "break your legs", "break your face",
    "smash your face", "burn your house", "come to your house", "find you and", "you are dead", "ur dead", "watch your back", "jaan se maar",
    "maar dunga", "maar dungi", "dekh lunga", "dekh lenge", "zinda nahi", "ghar aake", "haath pair tod",
]

EXTORTION_DEMAND = [
    "refund", "full refund", "money back", "paisa wapas", "paise wapas", "discount", "free stay", "free night", "compensation", "waive",
    "cancel my booking", "cancel the charge", "chargeback", "extra night", "upgrade", "cashback", "adjust the amount", "paisa", "paise", "money",
    "pay me", "de do", "wapas karo",
]

EXTORTION_CONDITIONAL = [
    "or i will", "or i'll", "or ill", "or else", "otherwise", "or we will", "if not", "if you don't", "if you dont", "unless you", "warna", "nahi to",
    "nahin to", "varna", "nahito", "vrna", "ya phir", "or main", "or mai",
]

EXTORTION_LEVERAGE = [
    "review", "reviews", "bad review", "negative review", "worst review", "rating", "bad rating", "low rating", "1 star", "one star", "1-star",
    "2 star", "two star", "zero star", "0 star", "complaint", "complain", "report you", "report this", "social media", "twitter", "instagram post",
    "viral", "expose you", "consumer court", "legal action", "police complaint", "fir", "review kar dunga", "review likh dunga", "rating gira dunga",
    "bura review", "galat review",
]

SCAM_URGENCY = [
    "right now", "immediately", "urgent", "urgently", "hurry", "quick", "last chance", "expires", "expiring", "only today", "today only",
    "limited time", "act fast", "within 10 minutes", "within 5 minutes", "jaldi", "abhi", "turant", "aaj hi", "jald se jald",
]

SCAM_PAYMENT = [
    "pay", "payment", "deposit", "advance", "booking amount", "token amount", "transfer", "send money", "upi", "gpay", "phonepe", "paytm",
    "bank details", "card details", "cvv", "otp", "pin", "netbanking", "wallet",
]

SCAM_TOO_GOOD = [
    "50% off", "60% off", "70% off", "80% off", "90% off", "half price", "free upgrade", "guaranteed", "no questions asked", "special price for you",
    "only for you", "secret deal", "insider rate", "below market",
]

ACCESS_TERMS = [
    "gate code", "gate pin", "door code", "door pin", "lock code", "lockbox", "lock box", "key code", "keypad code", "access code", "entry code",
    "building code", "smart lock", "keybox", "key box", "gate ka code",
]

ADDRESS_TERMS = [
    "address is", "full address", "exact address", "my address", "complete address", "address of the property", "property address",
    "here is the address", "sending the address", "sharing the address", "google maps", "maps link", "maps.app.goo.gl", "goo.gl/maps", "pin location",
    "share location", "sharing location", "live location", "location pin", "drop a pin", "dropping a pin", "ghar ka address", "address bhej",
    "location bhej", "address de dunga",
]

NOT_A_HANDLE = [
    "com", "the", "and", "for", "you", "your", "our", "app", "chat", "message", "group", "link", "profile", "page", "account", "story", "post",
    "reel", "please", "thanks", "hai", "hain", "kar", "karo", "par", "pe", "me", "on", "id", "handle", "username", "user", "is", "at", "claiming",
    "pretending", "saying", "asking", "telling", "offering", "instead", "about", "because", "before", "after", "today", "yesterday", "tomorrow",
    "again", "already", "also", "but", "just", "not", "never", "was", "were", "said", "says", "sent", "sends", "got", "get", "gets", "from", "with",
    "that", "this", "they", "them", "then", "when", "where", "which", "would", "could", "should", "some", "someone", "somebody", "anyone", "anybody",
    "everyone", "nobody", "myself", "yourself", "number", "numbers", "contact", "contacts", "details", "info",
]

BENIGN_CONTEXT_TERMS = [
    "\u20b9", "rs", "rs.", "inr", "\\$", "usd", "eur", "\u00a3", "per night", "per person", "total", "price", "cost", "amount", "paid", "bill",
    "charge", "deposit", "refund", "pin code", "pincode", "zip", "postal", "flight", "pnr", "train", "seat", "gate", "platform", "terminal",
    "booking ref", "booking id", "booking no", "ref no", "order id", "invoice", "gst", "gstin", "pan", "aadhaar", "check in", "check-in", "checkin",
    "check out", "check-out", "checkout", "nights?", "days?", "guests?", "adults?", "kids?", "children", "room", "villa", "flat", "apt", "apartment",
    "floor", "house no", "door no", "am", "pm", "hrs", "hours?", "minutes?", "mins?", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep",
    "oct", "nov", "dec", "sq ?ft", "kms?", "meters?", "metres?", "miles?", "wifi", "password", "passcode", "gate code", "door code", "otp", "gb",
    "mb", "tb", "mah", "mp", "inch",
]

AMBIGUOUS_WORDS = [
    "o", "oh", "to", "too", "for", "ate", "no", "do", "che", "one", "nil", "sat", "char", "tin",
]

HIGH_RISK_AMBIGUOUS = [
    "for", "no", "to", "too", "do", "one", "ate", "che",
]

NUM_WORDS = {
    "zero": "0", "oh": "0", "o": "0", "nought": "0", "naught": "0", "nil": "0", "one": "1", "two": "2", "to": "2", "too": "2", "three": "3",
    "four": "4", "for": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "ate": "8", "nine": "9", "shunya": "0", "sunya": "0",
    "shoonya": "0", "ek": "1", "aik": "1", "do": "2", "teen": "3", "tin": "3", "char": "4", "chaar": "4", "paanch": "5", "panch": "5", "paach": "5",
    "che": "6", "chhe": "6", "chah": "6", "chhah": "6", "saat": "7", "sat": "7", "aath": "8", "ath": "8", "nau": "9", "no": "9", "शून्य": "0",
    "एक": "1", "दो": "2", "तीन": "3", "चार": "4", "पांच": "5", "पाँच": "5", "छह": "6", "छे": "6", "सात": "7", "आठ": "8", "नौ": "9",
}

MULTIPLIERS = {
    "double": 2, "dubble": 2, "twice": 2, "triple": 3, "treble": 3, "thrice": 3, "quadruple": 4,
}

CONFUSABLES = {
    "\u0430": "a", "\u0410": "a", "\u0435": "e", "\u0415": "e", "\u043e": "o", "\u041e": "o", "\u0440": "p", "\u0420": "p", "\u0441": "c",
    "\u0421": "c", "\u0445": "x", "\u0425": "x", "\u0443": "y", "\u0423": "y", "\u0456": "i", "\u0406": "i", "\u0458": "j", "\u0408": "j",
    "\u043a": "k", "\u041a": "k", "\u043c": "m", "\u041c": "m", "\u043d": "h", "\u041d": "h", "\u0432": "b", "\u0412": "b", "\u0442": "t",
    "\u0422": "t", "\u0433": "r", "\u0455": "s", "\u0405": "s", "\u04bb": "h", "\u0501": "d", "\u051b": "q", "\u051d": "w", "\u0491": "g",
    "\u043f": "n", "\u03b1": "a", "\u0391": "a", "\u03b2": "b", "\u0392": "b", "\u03b5": "e", "\u0395": "e", "\u03bf": "o", "\u039f": "o",
    "\u03c1": "p", "\u03a1": "p", "\u03c4": "t", "\u03a4": "t", "\u03bd": "v", "\u039d": "n", "\u03ba": "k", "\u039a": "k", "\u03b9": "i",
    "\u0399": "i", "\u03c5": "u", "\u03c7": "x", "\u03a7": "x", "\u0396": "z", "\u0397": "h", "\u039c": "m", "\u03a5": "y", "\u03c3": "o",
    "\u03b3": "y", "\u0131": "i", "\u0142": "l", "\u00f8": "o", "\u0153": "oe", "\u00e6": "ae", "\u00df": "ss", "\u2113": "l", "\u217c": "l",
    "\u2170": "i", "\u24ea": "0", "\uff20": "@", "@": "@", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2015": "-",
    "\u2212": "-", "\ufe58": "-", "\uff0d": "-", "\u00b7": ".", "\u2022": ".", "\u2027": ".", "\uff0e": ".", "\u3002": ".", "\uff3f": "_",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u205f": " ", "\u3000": " ",
}

LEET = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t",
}
