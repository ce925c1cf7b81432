"""Explicit schemas of the tables and feeds (DDL strings; nothing is inferred)."""

ARCHETYPE_STATS = "set_code string, archetype_name string, colors string, format string, win_rate double, win_rate_history array<double>, games_count bigint"
CARD_STATS = "set_code string, card_name string, rarity string, colors string, filter_context string, format string, gih_wr double, alsa double, img_count bigint, win_rate_history array<double>"
CARD_LIST = "card_name string, set_code string, colors string, card_cmc double, card_cost string, rarity string, card_type string, arena_id bigint"
TROPHY_DECKS = "set_code string, format string, archetype string, aggregate_id string, wins int, losses int, trophy_time timestamp, cardlist map<string,int>, scraped_at timestamp"
RAW_DECK = "aggregate_id string, cards map<string,struct<name:string>>, groups array<struct<name:string,cards:array<bigint>>>"
RAW_CARD = "name string, cmc double, mana_cost string, type_line string, colors array<string>, rarity string, card_faces array<struct<mana_cost:string,type_line:string,colors:array<string>>>"
ARCHETYPE_RATING = "color_name string, games bigint, wins bigint, win_rate string"
CARD_RATING = "name string, rarity string, color string, ever_drawn_win_rate double, avg_seen double, game_count bigint, mtga_id bigint"
