"""Schemas of the tables that cross job boundaries."""

from __future__ import annotations

LEAD = """name string, website string, description string, source string, tags array<string>,
 discovered_at timestamp, score int, pos bigint, source_rank int, extra map<string,string>"""

SEED_FIELDS = "name: string, website: string, description: string, source: string"
SEED = "name string, website string, description string, source string"

PAGE_SNAPSHOT = "page_id bigint, url string, final_url string, status int, headers map<string,string>, html string"

PRODUCT_FEED = """data struct<posts: struct<edges: array<struct<node: struct<id: string, name: string,
 tagline: string, slug: string, url: string, website: string, createdAt: string,
 topics: struct<edges: array<struct<node: struct<name: string>>>>>>>>>"""

STORY_FEED = """hits array<struct<objectID: string, story_id: string, title: string, url: string,
 created_at: string, story_text: string, author: string, points: string>>"""

ACCELERATOR_FEED = """array<struct<id: string, slug: string, name: string, website: string, one_liner: string,
 long_description: string, all_locations: string, regions: array<string>, industry: string, tags: array<string>,
 launched_at: string, url: string, batch: string, stage: string, status: string>>"""

REPO_FEED = """items array<struct<id: string, name: string, full_name: string, description: string, homepage: string,
 html_url: string, pushed_at: string, updated_at: string, stargazers_count: string>>"""

POST_FEED = """data struct<children: array<struct<data: struct<id: string, name: string, title: string,
 selftext: string, subreddit: string, url: string, url_overridden_by_dest: string, created_utc: string,
 permalink: string>>>>"""

RSS_FEED = """channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string>>>,
 item array<struct<title: string, link: string, description: string, pubDate: string>>"""

ATOM_FEED = """entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string,
 content: string, updated: string>>"""
