"""Word lists of the tokenizer and the gates; parameters of every function that uses them."""

# Words that carry no meaning for retrieval.
STOP = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только её
мне было вот от меня ещё нет о из ему теперь когда даже ну вдруг ли если уже или ни быть
был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть
надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда
кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас
были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот
через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед
иногда лучше чуть том нельзя такой им более всегда конечно всю между это
the a an of to in on for and or is are be at by with from as that this it its into not
""".split()

# Endings cut by the tokenizer, longest first.
RU_SUFFIXES = ("иями", "ями", "ами", "ого", "ему", "ому", "ыми", "ими", "ешь", "ете", "ует", "уют",
               "ать", "ять", "ить", "ся", "ов", "ев", "ей", "ой", "ый", "ий", "ая", "яя", "ое",
               "ее", "ые", "ие", "ом", "ем", "ах", "ях", "ам", "ям", "ть", "ет", "ит", "ут",
               "ют", "ла", "ли", "ло", "а", "я", "ы", "и", "е", "у", "ю", "о", "ь")
EN_SUFFIXES = ("ing", "ies", "ed", "es", "s")

# Lines that never belong to a specification.
JUNK_LINES = ("Share", "Subscribe", "open it", "Copy link", "/")
JUNK_PARTS = ("Accept all", "More options", "cookie", "Cookie", "Unable to run in the current browser", "Privacy Policy", "Terms of Service")

# Tags whose content goes, tags that end a line, any tag.
HTML_DROPPED, HTML_BREAK, HTML_TAG = "(?s)<script.*?</script>|<style.*?</style>", "<(br|/p|/div|/h[1-6]|/li)[^>]*>", "<[^>]+>"

# White space and line ends as text libraries see them.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
RARE_LINE_END = r"[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"  # all but the line feed

# Type names that mark a copied project, names that say nothing, file names that must be equal.
BLACKLIST = """
Glyph GlyphPen GlyphShape GlyphKind GlyphStyle GlyphLayer GlyphMetrics GlyphBadge ScreenScrollView DefaultsVault Haptics
Typography TypeRole SignalKit Ink Workspace FramePanel RingGauge ActionKey CoverMotif CoverArt AppBackground ColorPalette
DataManager CustomTabBar SectionCard PrimaryButton ContentView HomeView LoaderView OnboardingView SettingsView LoadingView RootView
""".split()
GENERIC = """
CodingKeys Tone Point Link Kind Style Layer Metrics Section Row Tab Card Badge Item Entry State Mode Phase Step Stage Level
Constants Layout Theme Tag Note Filter Sort Field Unit Size Axis Direction Result Error Config Settings Snapshot
""".split()
FILES_ALLOWED = ("Glyphs.swift", "CoverArt.swift")

# Patterns of the gates over source lines.
STUBS = "(?i)lorem ipsum|placeholder text|coming soon…|not implemented|TODO:|FIXME"
FORCED = r"as! |try! |[a-zA-Z0-9_\]]!\.|[a-zA-Z0-9_]!\)|= *[a-zA-Z0-9_.]+!$"
UNFINISHED = r"(?i)\x22[^\x22]*\b(beta|alpha|trial version|demo version)\b"
VERSION_LITERAL = r"\x22[0-9]+\.[0-9]+\.[0-9]+\x22"
NETWORK = r"URLSession|WKWebView|SFSafariViewController|URL\(string: *\x22http|import Firebase|import StoreKit|import AppsFlyer|import OneSignal|import Adjust|import Amplitude"
REGIONAL = r"(?i)Locale\.current|TimeZone\(|#if RELEASE"
PERMISSION = "INFOPLIST_KEY_NS[A-Za-z]*UsageDescription"
SLOW_ART = r"\.blur\(|blendMode\(|repeatForever"
SATURATED = "(?i)dating|flashlight|wallpaper|fortune|horoscope|timer|sound effect|drinking|[Зз]накомств|[Фф]онарик|[Оо]бои|[Гг]адани|[Гг]ороскоп|[Тт]аймер"
