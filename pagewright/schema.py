"""Row shapes. Every table carries ``ord``: rows have no order of their own in Spark, so list order is data."""

IMAGES = "array<struct<file:string,page:int,index_on_page:int,caption:string>>"

PAGES = f"doc_key string, page int, text string, images {IMAGES}"
PARAGRAPHS = "doc_key string, ord bigint, style string, text string"
CHUNKS = (
    "ord bigint, chunk_id string, text string, source_doc string, doc_filename string, content_type string, "
    f"page int, section_heading string, fcp_number string, subsystem string, images {IMAGES}"
)
CAPTION_CHUNKS = CHUNKS + ", image_file string"
COMMANDS = (
    "ord bigint, record_id string, source_doc string, doc_filename string, content_type string, sl_no string, "
    "code string, cid string, mnemonic string, command_time string, date string, time string, milliseconds string, "
    "command_data string, data_cmd_value string, orbit_no string, status string, source_station string, "
    "dest_station string, subsystem string, text string"
)
CAPTION_STATE = "fname string, caption string"
CASES = (
    "id string, q string, note string, "
    "accept array<struct<meta:map<string,string>,text_contains:string,text_contains_any:array<string>>>, ord bigint"
)

# the scalar columns a stored row keeps, in output order
METADATA = [
    "source_doc", "doc_filename", "content_type", "page", "section_heading", "fcp_number", "subsystem",
    "is_sub_chunk", "parent_chunk_id", "sub_index", "date", "time", "cid", "mnemonic", "orbit_no", "status",
    "source_station", "dest_station", "has_images", "image_count", "image_file",
]
