"""Fixed schemas. Every table has one; nothing is inferred."""

from __future__ import annotations

PAGES = "course_id string, page_id string, identifier string, title string, content_type string, file_path string, canvas_url string, html string"

SPAN = "struct<nid:int,text:string,href:string,html:string,visible:boolean,to:string,destinations:int,covered:boolean,again:boolean,broken:boolean>"
#: Facts of a whole page; they stand on the row of its root alone.
PAGE_FACTS = (
    "struct<repeated_ids:array<struct<id:string,times:int>>,raw:string,has_body:boolean,body_chars:int,body_html:string,sub_headings:int,embeds:int,files:int,"
    f"links:array<{SPAN}>,"
    "list_runs:array<struct<nid:int,size:int,preview:string,html:string,single:boolean>>,"
    "empty_runs:array<struct<nid:int,size:int,tag:string,html:string>>,"
    "refs:array<struct<nid:int,attr:string,missing:array<string>,html:string>>,"
    "labels:array<struct<nid:int,target:string,known:boolean,html:string>>,"
    "videos:array<struct<nid:int,frame:boolean,url:string,html:string>>,"
    "choices:array<struct<nid:int,kind:string,name:string,html:string>>,"
    "code:array<string>,scripts:array<struct<src:string,text:string>>,help_href:string>"
)
TABLE_FACTS = "struct<rows:array<int>,first_cells:array<string>,colspan:string,first_cell:string,heads:array<string>,cells:int,empty:int,caption:string>"
INPUT = "struct<kind:string,label:string,aria:string,placeholder:string,name:string,html:string>"
#: One row for each element, and one (tag #document, nid 0) for the page.
ELEMENT = (
    "nid int, tag string, attrs map<string,string>, text string, html string, parent_tag string, parent_chars int, above array<string>, in_body boolean, "
    "styles array<string>, below map<string,int>, alts array<string>, img_width string, img_height string, kids array<string>, "
    "prev struct<tag:string,text:string,style:string,class:string,bold:boolean>, next_tag string, next_text string, "
    "beside struct<tag:string,href:string,text:string,image:boolean>, next_href string, next_adjacent boolean, prev_level int, "
    "near array<struct<alt:string,html:string>>, focusable boolean, focusable_below boolean, captioned boolean, "
    f"grid {TABLE_FACTS}, heads_without_scope array<struct<text:string,html:string>>, empty_heads array<string>, inputs array<{INPUT}>, page {PAGE_FACTS}"
)
ELEMENTS = "course_id string, page_id string, identifier string, title string, content_type string, canvas_url string, " + ELEMENT

ISSUES = (
    "id string, course_id string, rule_id string, severity string, category string, wcag_criterion string, message string, page_id string, page_identifier string, "
    "page_title string, content_type string, canvas_url string, element_html string, can_auto_fix boolean, fix_description string, source string, "
    "axe_meta struct<fg_color:string,bg_color:string,contrast_ratio:double,expected_ratio:string,font_size:string,font_weight:string,target:string>, rule_ord int, nid int, seq int"
)
