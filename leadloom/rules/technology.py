"""Technology markers. Name, category, base confidence, markers, header markers."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TechnologyRule:
    name: str
    category: str
    confidence: int
    markers: tuple[str, ...] = ()
    headers: tuple[tuple[str, str], ...] = ()


TECHNOLOGY_RULES = (
    TechnologyRule("React", "frontend", 75, ("react", "react-dom", "data-reactroot", "_next/static", "__NEXT_DATA__")),
    TechnologyRule("Vue", "frontend", 80, ("vue.js", "vue.min.js", "data-v-", "__vue__", "nuxt")),
    TechnologyRule("Angular", "frontend", 85, ("ng-version", "angular.js", "angular.min.js", "ng-app")),
    TechnologyRule("Next.js", "frontend", 90, ("_next/static", "__NEXT_DATA__", "next/dist", "next.js")),
    TechnologyRule("Nuxt", "frontend", 90, ("__NUXT__", "_nuxt/", "nuxt.js")),
    TechnologyRule("Svelte", "frontend", 80, ("svelte", "__svelte")),
    TechnologyRule(
        "Bootstrap", "frontend", 85,
        ("bootstrap.min.css", "bootstrap.min.js", "bootstrap.css", "cdn.jsdelivr.net/npm/bootstrap"),
    ),
    TechnologyRule("Tailwind", "frontend", 85, ("tailwindcss", "tailwind.min.css", "cdn.tailwindcss.com")),
    TechnologyRule("jQuery", "frontend", 85, ("jquery.min.js", "jquery.js", "cdnjs.cloudflare.com/ajax/libs/jquery")),
    TechnologyRule("Laravel", "backend", 70, ("laravel", "csrf-token", "laravel_session")),
    TechnologyRule("Django", "backend", 75, ("csrfmiddlewaretoken", "django", "csrftoken")),
    TechnologyRule("Ruby on Rails", "backend", 75, ("rails-ujs", "data-turbolinks", "csrf-param", "ruby on rails")),
    TechnologyRule("Express", "backend", 80, ("express",), (("x-powered-by", "express"),)),
    TechnologyRule(
        "ASP.NET", "backend", 80, ("aspnet", "asp.net", "__viewstate", "webforms"),
        (("x-powered-by", "asp.net"), ("x-aspnet-version", "")),
    ),
    TechnologyRule(
        "Cloudflare", "hosting", 90, ("cdnjs.cloudflare.com", "cloudflare"),
        (("server", "cloudflare"), ("cf-ray", ""), ("cf-cache-status", "")),
    ),
    TechnologyRule(
        "Vercel", "hosting", 90, ("vercel", "vercel.app", "_vercel"), (("server", "vercel"), ("x-vercel-id", "")),
    ),
    TechnologyRule(
        "Netlify", "hosting", 90, ("netlify", "netlify.app", "netlify-identity"),
        (("server", "netlify"), ("x-nf-request-id", "")),
    ),
    TechnologyRule(
        "AWS", "hosting", 85, ("amazonaws.com", "cloudfront.net", "aws-amplify"),
        (("server", "amazons3"), ("x-amz-cf-id", ""), ("x-amz-request-id", "")),
    ),
    TechnologyRule(
        "Google Cloud", "hosting", 70, ("googleapis.com", "gstatic.com", "appspot.com", "googleusercontent.com"),
    ),
    TechnologyRule("Azure", "hosting", 80, ("azurewebsites.net", "azureedge.net", "windows.net", "azure.com")),
    TechnologyRule(
        "Google Analytics", "analytics", 90,
        ("google-analytics.com", "gtag(", "ga(", "analytics.js", "googletagmanager.com/gtag"),
    ),
    TechnologyRule("Google Tag Manager", "analytics", 90, ("googletagmanager.com/gtm.js", "gtm.start", "GTM-")),
    TechnologyRule("Plausible", "analytics", 95, ("plausible.io", "plausible.min.js")),
    TechnologyRule("Mixpanel", "analytics", 90, ("mixpanel", "cdn.mxpnl.com")),
    TechnologyRule("Segment", "analytics", 85, ("cdn.segment.com", "analytics.min.js", "segment.com")),
    TechnologyRule("Hotjar", "analytics", 90, ("static.hotjar.com", "hotjar", "hj(")),
    TechnologyRule("Intercom", "customer_support", 90, ("widget.intercom.io", "intercom", "intercomSettings")),
    TechnologyRule("Crisp", "customer_support", 95, ("client.crisp.chat", "crisp.chat")),
    TechnologyRule("Zendesk", "customer_support", 90, ("static.zdassets.com", "zendesk", "zopim")),
    TechnologyRule("Drift", "customer_support", 90, ("js.driftt.com", "drift.com", "driftt")),
    TechnologyRule("Stripe", "payment", 90, ("js.stripe.com", "stripe.com", "Stripe(")),
    TechnologyRule("Paddle", "payment", 90, ("cdn.paddle.com", "paddle.js", "paddle.com")),
    TechnologyRule("LemonSqueezy", "payment", 95, ("lemonsqueezy.com", "assets.lemonsqueezy.com")),
    TechnologyRule("Clerk", "authentication", 90, ("clerk.accounts.dev", "clerk.com", "@clerk")),
    TechnologyRule("Auth0", "authentication", 90, ("cdn.auth0.com", "auth0.com", "auth0-js")),
    TechnologyRule("Firebase Auth", "authentication", 80, ("firebase", "firebaseapp.com", "identitytoolkit.googleapis.com")),
    TechnologyRule("Supabase Auth", "authentication", 90, ("supabase.co", "supabase.js", "@supabase")),
)

# Mobile detection: call-to-action phrases and schemes that are no deep links.
APP_PHRASES = (
    "download app", "get the app", "download on the app store", "download on app store", "get it on google play",
    "get it on the google play", "open in app", "open app", "install the app", "available on the app store",
    "available on google play",
)
PLAIN_SCHEMES = (
    "http", "https", "mailto", "tel", "sms", "ftp", "file", "data", "javascript", "about", "blob",
)
UNIVERSAL_MARKS = ('rel="alternate"', "apple-app-site-association", "app-site-association", "android:host")
BUTTON_PATTERNS = (
    "<a[^>]*>[^<]*(download|get the app|open in app|open app)[^<]*</a>",
    "<button[^>]*>[^<]*(download|get the app|open in app|open app)[^<]*</button>",
)
MOBILE_CONFIDENCE = {
    "google_play_link": 95, "apple_app_store_link": 95, "smart_banner": 90, "universal_link": 70,
    "android_intent_link": 85, "deep_link": 65, "download_app_button": 75, "footer_app_link": 80,
    "navigation_app_link": 80, "mobile_cta_button": 70,
}
