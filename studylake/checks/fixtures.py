"""Derived input tables, as SQL text that Spark SQL and DuckDB both accept.

All are built from whole base tables by string arithmetic, so that an operator and its SQL twin
see identical rows and the work grows with the base tables.
"""

from __future__ import annotations

import re

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FIXTURES: dict[str, str] = {}

# --- study warehouse tables ---------------------------------------------------------------

FIXTURES["study"] = """
select concat('ST', cast(c_custkey as string)) as alias,
 case c_custkey % 6 when 0 then 'Phase 3' when 1 then 'phase II' when 2 then 'PHASE iv' when 3 then '1' when 4 then 'Phase X' else null end as phase_raw,
 c_mktsegment as area,
 case c_custkey % 7 when 0 then 'Y' when 1 then ' no ' when 2 then 'TRUE' when 3 then '0' when 4 then 'maybe' else null end as pediatric_raw
from customer
"""

FIXTURES["study_country"] = """
select distinct concat('ST', cast(o_custkey as string)) as alias, n_name as country, upper(substring(n_name,1,2)) as abbr,
 case when o_orderstatus='P' then null else o_orderstatus end as status
from orders join lineitem on o_orderkey=l_orderkey join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey
"""

FIXTURES["enrollment"] = """
select concat('ST', cast(o_custkey as string)) as alias,
 case o_orderkey % 3 when 0 then 'Enrolled' when 1 then 'Screened' else 'Completed' end as enrollment_type,
 case when o_orderpriority like '1%' or o_orderpriority like '2%' then 'Planned' else 'Actual' end as plan_kind,
 case when o_orderkey % 11 = 0 then null else cast(floor(o_totalprice/100) as int) end as total
from orders
"""

FIXTURES["milestone"] = """
select concat('ST', cast(user_id as string)) as alias,
 case event_type when 'view' then 'Protocol Approval' when 'click' then 'First Patient Visit' when 'purchase' then 'Primary Outcome Last Patient Visit'
  when 'signup' then 'All Outcomes LPV' else 'First Patient Entered Treatment' end as milestone_type,
 case when event_id % 13 = 0 then null else cast(ts as date) end as milestone_date
from events
"""

# Order lines with a line number that is unique within the order.
FIXTURES["item"] = """
select l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
 cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) as int) as l_linenumber
from lineitem
"""

# --- protocol lines: contents lines, sections, pipe tables, footnotes, trailing JSON -------

FIXTURES["protocol_line"] = """
select o_orderkey as doc_id, ln as line_no, txt as text from (
 select o_orderkey, 0 as ln, concat('Protocol Number: H', cast(o_orderkey % 9 as string), 'X-MC-', upper(substring(o_orderpriority,3,2)), cast(o_orderkey as string)) as txt from orders
 union all select o_orderkey, 1, '1. Overview ........ 3' from orders
 union all select o_orderkey, 2, '1.3. Schedule of Activities ........ 9' from orders
 union all select o_orderkey, 3, case when o_orderkey % 4 = 0 then '# 1. Overview' else '1. Overview' end from orders
 union all select o_orderkey, 4, concat('A Phase ', cast(o_orderkey % 4 + 1 as string), ' Study of item ', cast(o_custkey as string)) from orders
 union all select o_orderkey, 5, case when o_orderkey % 4 = 0 then '## 1.3. Schedule of Activities' else '1.3. Schedule of Activities' end from orders
 union all select o_orderkey, 6, '| Procedure | Visit 1 | Visit 2 | Visit 3 | Comments |' from orders
 union all select o_orderkey, 7, '| --- | --- | --- | --- | --- |' from orders
 union all select l_orderkey, 10 + l_linenumber, concat('| ', p_type, ' | ', case when cast(l_quantity as int) % 2 = 0 then 'X' else '' end, ' | ',
   case when cast(l_quantity as int) % 3 = 0 then 'X' else '' end, ' | ', case when l_returnflag='R' then 'X' else '' end,
   case when l_linenumber % 5 = 4 then ' |' else concat(' | ', l_linestatus, ' |') end)
  from item join part on l_partkey=p_partkey
 union all select o_orderkey, 60, case when o_orderkey % 3 = 0 then '* taken before dosing' else 'No marks are used.' end from orders
 union all select o_orderkey, 61, case when o_orderkey % 2 = 0 then 'on the same day' else 'Second line' end from orders
 union all select o_orderkey, 62, '' from orders
 union all select o_orderkey, 70, '| Code | Value |' from orders
 union all select o_orderkey, 71, concat('| status | ', o_orderstatus, ' |') from orders
 union all select o_orderkey, 72, '|  |  |' from orders
 union all select o_orderkey, 100, '' from orders
 union all select o_orderkey, 101, case when o_orderkey % 4 = 0 then '# 2. Population' else '2. Population' end from orders
 union all select o_orderkey, 102, concat('Approximately ', cast(cast(floor(o_totalprice/1000) as int) as string), ' patients will be enrolled.') from orders
 union all select o_orderkey, 103, 'CONFIDENTIAL' from orders
 union all select o_orderkey, 104, concat('Page ', cast(o_orderkey % 90 as string), ' of 90') from orders
 union all select o_orderkey, 110, case when o_orderkey % 7 = 0 then '10. Other matters' else '10.2. Appendix 2: Clinical Laboratory Tests' end from orders
 union all select o_orderkey, 111, '| Clinical Laboratory Tests | Comments |' from orders
 union all select o_orderkey, 112, '|---|---|' from orders
 union all select l_orderkey, 120 + l_linenumber, concat('| ', p_name, ' ', case l_linenumber % 4 when 0 then 'pregnancy test' when 1 then 'CK-MB' when 2 then 'sample' else 'HIV' end, ' | ',
   case when l_returnflag='R' then 'Results will not be reported to sites' when l_returnflag='A' then 'blinded after randomization' else '' end, ' |')
  from item join part on l_partkey=p_partkey
 union all select o_orderkey, 180, '10.3. Appendix 3: Other matters' from orders
 union all select o_orderkey, 181, 'Genetics will be collected.' from orders
 union all select o_orderkey, 200, '{' from orders where o_orderstatus = 'F'
 union all select o_orderkey, 201, '  "pages": [' from orders where o_orderstatus = 'F'
 union all select o_orderkey, 202, '  ]}' from orders where o_orderstatus = 'F'
) t
"""

FIXTURES["cell"] = """
select doc_id, line_no, text, i.island from protocol_line p join (
  select doc_id as d, line_no as l, max(case when prev is null or prev = 0 then line_no end) over (partition by doc_id order by line_no) as island from (
    select doc_id, line_no, m, lag(m) over (partition by doc_id order by line_no) as prev from (
      select doc_id, line_no, case when text like '|%' then 1 else 0 end as m from protocol_line) a) b where m = 1
) i on p.doc_id = i.d and p.line_no = i.l
"""

# --- design lines: numbered headings, plain or inside table rows ----------------------------

FIXTURES["design_line"] = """
select o_orderkey as doc_id, ln as line_no, txt as text from (
 select o_orderkey, 0 as ln, 'Clinical design elements' as txt from orders
 union all select o_orderkey, 1, concat('Therapeutic Area: ', c_mktsegment, ' (draft).') from orders join customer on o_custkey = c_custkey
 union all select o_orderkey, 2, case when o_orderkey % 3 = 0 then '| 12. Immunogenicity testing | Immunogenicity testing is Yes |' else '12. Immunogenicity testing' end from orders
 union all select o_orderkey, 3, case when o_orderkey % 3 = 0 then 'No pediatric participants' else 'Immunogenicity: No' end from orders
 union all select o_orderkey, 10, '38. Country Allocation / Sites' from orders
 union all select o_orderkey, 11, concat('Based on the plan, US at target ', cast(o_orderkey % 60 + 10 as string), '% and Germany at target 10%.') from orders
 union all select o_orderkey, 12, '38.1. Country Check' from orders
 union all select o_orderkey, 13, 'Checked by the team' from orders where o_orderkey % 2 = 0
 union all select o_orderkey, 14, ' 38.2. Sites | see the list | ' from orders where o_orderkey % 5 = 0
 union all select o_orderkey, 20, case when o_orderkey % 2 = 0 then '39. Planned Enrollment' else '| 39. Planned Enrollment | as below |' end from orders
 union all select o_orderkey, 21, case o_orderkey % 4 when 0 then concat('Approximately ', cast(o_custkey + 100 as string), ' patients will be enrolled.')
    when 1 then concat('Randomized: ', cast(o_custkey + 10 as string)) when 2 then concat(cast(o_custkey + 100 as string), ' patients are planned') else 'Not known yet' end from orders
 union all select o_orderkey, 22, concat('Screen failure rate: ', cast(o_orderkey % 50 as string), '%') from orders where o_orderkey % 3 < 2
 union all select o_orderkey, 23, concat('Early discontinuation rate is ', cast(o_orderkey % 20 + 1 as string), '%') from orders where o_orderkey % 7 < 4
 union all select o_orderkey, 30, '45. Timeline' from orders
 union all select o_orderkey, 31, concat('Protocol Approval: ', cast(o_orderkey % 28 + 1 as string), '-Jan-2026') from orders
 union all select o_orderkey, 32, case when o_orderkey % 5 = 0 then 'FPV: TBD' else concat('FPV: ', cast(o_orderkey % 28 + 1 as string), '-March-2026') end from orders
 union all select o_orderkey, 33, concat('LPV: December-', cast(2027 + o_orderkey % 3 as string), '.') from orders
 union all select o_orderkey, 40, '50. Decentralized trial' from orders where o_orderkey % 2 = 1
 union all select o_orderkey, 41, case when o_orderkey % 3 = 1 then 'Decentralized services required No' else 'Genetics collected: Yes' end from orders where o_orderkey % 2 = 1
) t
"""

# --- one-paragraph fact sheets ---------------------------------------------------------------

FIXTURES["fact_sheet"] = """
select o_orderkey as doc_id, concat(
 case o_orderkey % 6 when 0 then concat('Protocol Number: H', cast(o_orderkey % 9 as string), 'X-MC-AB', cast(o_orderkey % 900 as string)) when 1 then concat('Trial ID: T R-', cast(o_orderkey as string), 'X')
  when 2 then concat('Clinical Protocol AB1-CD2-', cast(o_orderkey as string)) when 3 then concat('Study No ', 'ST', cast(o_orderkey + 1000 as string)) when 4 then concat('Protocol: Q', cast(o_orderkey + 100 as string)) when 5 then concat('Protocol Number: H', cast(o_orderkey % 9 as string), 'X-M C-A B', cast(o_orderkey % 900 as string)) else 'No code here' end, chr(10),
 case o_orderkey % 7 when 0 then concat('Compound: alphastat (QX', cast(o_orderkey + 1000000 as string), ')') when 1 then concat('Compound: QX', cast(o_orderkey + 1000000 as string)) when 2 then 'Compound: gammaline forte; tablets'
  when 3 then 'Investigational Product: deltamab  injection' when 4 then concat('Also QX', cast(o_orderkey + 2000000 as string), ' was given') when 5 then 'A Study of Zetamide in adults' else 'A Study of Patients in adults' end, chr(10),
 case o_orderkey % 5 when 0 then case when o_orderkey % 2 = 0 then 'Phase: 2b' else 'P h a s e: 2b' end when 1 then 'A Phase 3, Randomized design' when 2 then 'Phase III Trial' when 3 then 'In Phase IV' else 'phase 2' end, chr(10),
 case o_orderkey % 4 when 0 then concat('Therapeutic Area: ', o_orderpriority, ' (part of plan).') when 1 then concat('Condition: ', o_orderpriority, ' pain.') when 2 then concat('Primary Diagnosis: type ', cast(o_orderkey % 10 as string), ' diabetes') else 'Area unknown' end, chr(10),
 case o_orderkey % 11 when 0 then 'Indication: chronic migraine' when 1 then 'Indication (): severe  asthma.' when 2 then concat('Protocol Title: Long term safety in ', 'adults with gout', '.') else 'Nothing indicated' end, chr(10),
 case o_orderkey % 8 when 0 then concat('Approximately ', cast(cast(floor(o_totalprice/10) as int) as string), ' patients will be enrolled.') when 1 then concat('The sample size is ', cast(o_orderkey % 700 as string), '.') when 2 then concat('N = ', cast(o_orderkey % 900 + 100 as string))
  when 3 then concat(cast(o_orderkey % 900 + 100 as string), ' subjects will be randomized') when 4 then 'A p p r o x i m a t e l y 1,240 participants' when 5 then 'Up to 455-570 participants, maximum 600' when 6 then concat('Enrollment of 1999 patients and ', cast(o_orderkey % 80 as string), ' sites') else 'No numbers' end, chr(10),
 case o_orderkey % 9 when 0 then 'Participants must be at least 18 years of age' when 1 then 'aged 12 to 17 years' when 2 then concat(cast(o_orderkey % 50 + 10 as string), ' years of age or older') when 3 then 'Age at screening: 21' when 4 then 'Inclusion Criteria: adults of at least 40 years' else 'any age' end, chr(10),
 case o_orderkey % 10 when 0 then 'Is immunogenicity testing needed? Yes' when 1 then 'Immunogenicity: No' when 2 then 'immunogenicity assessment will be performed' else 'none' end, chr(10),
 case o_orderkey % 12 when 0 then 'We will collect PGx Yes' when 1 then 'Genetics samples collected: No' when 2 then 'no genetics planned' when 3 then 'Pharmacogenomic work' else 'none' end, chr(10),
 case o_orderkey % 13 when 0 then 'Screen failure rate: 25%' when 1 then 'Screen fail 97%' when 2 then '40% screen failure rate' else 'rate unknown' end, chr(10),
 case o_orderkey % 14 when 0 then 'PK and biomarker samples; ADA testing' when 1 then 'anti-drug antibody' when 2 then 'pembrolizumab for melanoma' when 3 then 'anti-PD1 and tumour response' else 'none' end) as text
from orders
"""

# --- country sentences -----------------------------------------------------------------------

FIXTURES["country_text"] = """
select o_orderkey as doc_id, concat(
 case o_orderkey % 4 when 0 then concat('For this trial ', a, ', Japan and USA will be in scope for country allocation. ') when 1 then concat('Some words on ', a, '. ') else '' end, chr(10),
 case o_orderkey % 3 when 0 then concat('Here consideration can be given to ', b, ' and Spain. ') else 'Nothing further. ' end, chr(10),
 case o_orderkey % 5 when 0 then concat('Based on XYZ countries in scope include ', b, ' and US', chr(10), 'US at target 60%', chr(10), c, ' at target 10%', chr(10), 'Other XBU: Italy and Poland.') else 'No list. ' end, chr(10),
 case o_orderkey % 6 when 0 then concat('| Country Check | e.g. United States, Canada | note | ', a, ' and ', b, ' will be in scope |') when 1 then concat('| Country Check | e.g. Canada | note | ', b, ' for consideration |') when 2 then concat('Country check: ', c) else 'no row' end, chr(10),
 case o_orderkey % 7 when 0 then concat('12 sites in ', c, '.') when 1 then concat('The trial is sited all in the ', a, '.') when 2 then concat('A ', b, '-only design.') when 3 then concat('About 340 subjects will be enrolled across ', a, ' and ', c, '.') else 'End.' end, chr(10),
 case o_orderkey % 8 when 0 then concat('Country where initial FPV planned: ', b) when 1 then concat('First country for FPV: ', c, '; later others') when 2 then 'Initial FPV is planned in US.' else 'none' end) as text
from (select o_orderkey, elm(1 + cast(o_orderkey % 6 as int)) as a, elm(1 + cast(o_custkey % 6 as int)) as b, elm(1 + cast((o_orderkey + o_custkey) % 6 as int)) as c from orders) t
"""
_NAMES = "'Germany' when 2 then 'United Kingdom' when 3 then 'France' when 4 then 'South Korea' when 5 then 'BR' else 'canada'"
FIXTURES["country_text"] = re.sub(
    r"elm\(((?:[^()]|\([^()]*(?:\([^()]*\)[^()]*)*\))*)\)", lambda m: f"case {m.group(1)} when 1 then {_NAMES} end", FIXTURES["country_text"]
)

FIXTURES["country_list"] = """
select o_orderkey as doc_id, concat(n_name, case when o_orderkey % 3 = 0 then ' (60%)' when o_orderkey % 3 = 1 then ' (12.5%)' else '' end, ', , Spain',
 case when o_orderkey % 2 = 0 then ' (consideration)' else '' end) as raw
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
"""

FIXTURES["allocation"] = """
select o_orderkey as doc_id, case l_linenumber when 1 then 'US' when 2 then 'China' when 3 then 'UK' when 4 then 'Switzerland' when 5 then 'India' when 6 then 'Brazil' else 'South Korea' end as abbreviation,
 case when l_linenumber % 3 = 0 then null else round(l_discount * 5, 2) end as pct, cast(floor(o_totalprice / 1000) as int) as enrolled, l_returnflag = 'R' as consideration
from item join orders on l_orderkey = o_orderkey
"""

# --- milestone sentences and dates -----------------------------------------------------------

FIXTURES["milestone_text"] = """
select o_orderkey as doc_id, concat('Intro. ',
 case o_orderkey % 3 when 0 then concat('Document Key Milestone Estimates', chr(10), 'Protocol Approval: ', d, '-July-2026', chr(10), 'FPV: December-2026', chr(10), 'LPV:', chr(10)) when 1 then concat('Timeline', chr(10), 'FPV: ', d, '-Jan-2027', chr(10)) else 'No plan. ' end,
 case o_orderkey % 4 when 0 then concat('First Patient Visit: 2026-03-', lpad(d, 2, '0'), chr(10)) when 1 then concat('Last Subject Out : May 2029', chr(10)) else '' end,
 case o_orderkey % 5 when 0 then concat('Treatment may end on 1-June-2027 or by March 2028 (LPET) as said. ') when 1 then concat('Dosing is expected on ', d, '-May-2027 ( FPET ). ') else '' end) as text
from (select o_orderkey, cast(o_orderkey % 28 + 1 as string) as d from orders) t
"""

FIXTURES["date_text"] = """
select o_orderkey as doc_id, case o_orderkey % 11 when 0 then concat(d, '-Jan-2026') when 1 then concat(d, '-January-2026') when 2 then concat(d, ' Mar 2027') when 3 then concat(d, ' March 2027')
  when 4 then concat('2028-05-', lpad(d, 2, '0')) when 5 then 'Jun-2026' when 6 then 'June-2026' when 7 then 'Sep 2026' when 8 then 'September 2026' when 9 then 'TBD' else concat('35-Jan-', d) end as first_visit,
 case when o_orderkey % 6 = 0 then null else concat(d, '-Aug-', cast(2029 + o_orderkey % 4 as string)) end as last_visit, cast(o_orderdate as date) as day
from (select o_orderkey, o_orderdate, cast(o_orderkey % 28 + 1 as string) as d from orders) t
"""

FIXTURES["language_text"] = """
select o_orderkey as doc_id, case o_orderkey % 4 when 0 then concat('Before. Translations list: ', o_orderpriority, ' German, french and Japanese') when 1 then 'Plain. Translate into Spanish and Thai' when 2 then 'Languages: none' else concat('Polish text ', o_orderpriority) end as text
from orders
"""

# --- question tables ---------------------------------------------------------------------------

FIXTURES["question_line"] = """
select o_orderkey as doc_id, ln as line_no, txt as text from (
 select o_orderkey, 0 as ln, case when o_orderkey % 2 = 0 then '| Q# | Sub Section | Design Element | Design Detail |' else '`Q#' end as txt from orders
 union all select o_orderkey, 1, '|---|---|---|---|' from orders where o_orderkey % 2 = 0
 union all select o_orderkey, 1 + l_linenumber * 8, concat('| ', cast(l_linenumber as string), ' | ', s, ' | ', e, ' | ', d, ' |') from qa where o_orderkey % 2 = 0
 union all select o_orderkey, 1 + l_linenumber * 8, cast(l_linenumber as string) from qa where o_orderkey % 2 = 1
 union all select o_orderkey, 2 + l_linenumber * 8, s from qa where o_orderkey % 2 = 1
 union all select o_orderkey, 3 + l_linenumber * 8, e from qa where o_orderkey % 2 = 1
 union all select o_orderkey, 4 + l_linenumber * 8, d from qa where o_orderkey % 2 = 1
) t
"""
FIXTURES["qa"] = """
select l_orderkey as o_orderkey, l_linenumber,
 case l_linenumber when 1 then 'Title' when 2 then 'Stats' when 3 then 'Timeline' when 4 then 'Country Check' when 5 then 'Design' when 6 then 'Peds' else 'Overview' end as s,
 case l_linenumber when 1 then 'Phase of study' when 5 then case when l_returnflag = 'R' then 'Immunogenicity' else 'Genetics / PGx' end when 7 then 'Regulatory and country scope' else 'Element' end as e,
 case l_linenumber when 1 then concat('Phase ', cast(l_partkey % 3 + 1 as string), case when l_partkey % 5 = 0 then ' study of asthma' else ' study' end)
  when 2 then concat(case when l_partkey % 2 = 0 then 'N=' else 'Approximately ' end, cast(l_partkey as string), ' with discontinuation rate of approximately ', cast(l_partkey % 30 as string), '% and screen fail rate: ', cast(l_partkey % 40 as string), '%')
  when 3 then 'Protocol Approval: 15-Jan-2026 First Patient Visit: March 2026 Interim Timepoint(s) (if applicable): June 2026 Last Patient Visit: TBD'
  when 4 then concat('Germany 20% and Japan. Also France for consideration', case when l_partkey % 2 = 0 then ' and Spain' else '' end)
  when 5 then case when l_returnflag = 'A' then 'Yes, will be collected' else 'No' end
  when 6 then case when l_returnflag = 'A' then 'aged 12 to 17 years' when l_returnflag = 'N' then 'adults only' else 'adolescent group' end
  else 'Sites in US and Canada for lupus' end as d
from item
"""

# --- schedule matrix rows -------------------------------------------------------------------------

FIXTURES["matrix_line"] = """
select o_orderkey as doc_id, ln as line_no, txt as text from (
 select o_orderkey, 0 as ln, '| QXRD | Period I | Treatment | Comments | |' as txt from orders
 union all select o_orderkey, 1, '| Part A1 | SCR | | Treatm | |' from orders where o_orderkey % 3 = 0
 union all select o_orderkey, 2, '|  | | -35 to | | |' from orders where o_orderkey % 2 = 0
 union all select o_orderkey, 3, case when o_orderkey % 5 = 0 then '| Days in study | -2 | 1 | 8 |' else '| Study day | -2 | 1 | 8 |' end from orders
 union all select o_orderkey, 4, '|---|---|---|---|---|' from orders
 union all select o_orderkey, 5, '| Laboratory tests and sa | mple co | llect | ions | |' from orders where o_orderkey % 4 = 0
 union all select o_orderkey, 6, '| Vital signs and | | | | |' from orders where o_orderkey % 4 = 1
 union all select o_orderkey, 7, '| other assessments | | | | |' from orders where o_orderkey % 4 = 1
 union all select l_orderkey, 10 + l_linenumber * 2, concat('| ', p_type, ' | ', case when cast(l_quantity as int) % 2 = 0 then 'X' else '' end, ' | ',
   case when cast(l_quantity as int) % 3 = 0 then 'X' else '' end, ' | ', case when l_returnflag='R' then 'X' else '' end, ' | ', case when l_linestatus = 'O' then 'fasted' else '' end, ' |')
  from item join part on l_partkey=p_partkey
 union all select l_orderkey, 11 + l_linenumber * 2, '| and follow-up | | | | see note |' from item where l_linenumber % 3 = 1
 union all select o_orderkey, 46, '| QXRD note block | Q1 | Q2 | | |' from orders where o_orderkey % 6 = 0
 union all select o_orderkey, 47, '| QXRD note block | Q1 | | Q2 | |' from orders where o_orderkey % 6 = 0
 union all select o_orderkey, 48, '| QXRD note block | | Q1 | Q2 | |' from orders where o_orderkey % 6 = 0
 union all select o_orderkey, 50, '| Table 2 Second part | | |' from orders
 union all select o_orderkey, 51, '| Part B | | |' from orders where o_orderkey % 3 = 0
 union all select o_orderkey, 52, case when o_orderkey % 7 = 0 then '| Visit | -2 | 1 | 8 |' else '| Visit | 15 | 22 |' end from orders
 union all select l_orderkey, 60 + l_linenumber, concat('| ', p_type, ' | ', case when cast(l_quantity as int) % 5 = 0 then 'X' else '' end, ' | X | ', case when l_returnflag = 'A' then 'late' else '' end, ' |')
  from item join part on l_partkey=p_partkey where l_linestatus = 'F'
) t
"""

FIXTURES["mark"] = """
select l_orderkey as doc_id, l_linenumber % 2 as table_ord, l_linenumber as row_ord, p_type as label, v as visit_ord,
 case v when 0 then 'Visit 1' when 1 then case when l_linenumber % 2 = 0 then 'Visit 2' else 'Visit 3' end else 'Visit 9' end as visit,
 case v when 0 then case when l_returnflag = 'R' then 'X' else '' end when 1 then case when l_linestatus = 'O' then 'X' else '' end else case when l_returnflag = 'A' then l_linestatus else '' end end as mark,
 case when l_tax > 0.05 then l_returnflag else '' end as comment
from item join part on l_partkey = p_partkey cross join (select 0 as v union all select 1 union all select 2) n
"""

FIXTURES["visit_cell"] = """
select o_orderkey as doc_id, row_no, col_no, text from (
 select o_orderkey, 0 as row_no, 0 as col_no, 'Procedure' as text from orders
 union all select o_orderkey, 0, 1, case o_orderkey % 9 when 0 then 'Visit 1' when 1 then 'Screening' when 2 then 'Day 1-3' when 3 then 'Visit 3 Hour 2' when 4 then 'Comments' when 5 then 'Week 4' when 6 then '12 hr' when 7 then 'Follow-up' else 'A long header text' end from orders
 union all select o_orderkey, 0, 2, case o_orderkey % 5 when 0 then '' when 1 then 'RT' when 2 then 'EOS' when 3 then 'Study Week' else 'Predose' end from orders
 union all select l_orderkey, l_linenumber, 0, case l_partkey % 12 when 0 then 'Laboratory Assessments' when 1 then 'Vital signs' when 2 then '12-lead ECG' when 3 then 'Hematology' when 4 then 'LABORATORY WORK' when 5 then 'Tests'
   when 6 then 'PK sample' when 7 then 'Informed consent' when 8 then 'Body weight' when 9 then 'Clinical chemistry' when 10 then 'Follow-up blood sample' else 'ECOG performance status' end from item
 union all select l_orderkey, l_linenumber, 1, case when l_partkey % 3 = 0 then '' else 'X' end from item
 union all select l_orderkey, l_linenumber, 2, case when l_partkey % 3 = 0 then ' ' else '' end from item
) t
"""

# --- schedule and panel lines ----------------------------------------------------------------------

FIXTURES["mapper_line"] = """
select o_orderkey as doc_id, ln as line_no, txt as text from (
 select o_orderkey, 0 as ln, 'Laboratory tests and sample collections' as txt from orders
 union all select o_orderkey, 1, case when o_orderkey % 2 = 0 then 'Visit Number  1  2  3  4' else 'Visit Number  5  7  9' end from orders
 union all select o_orderkey, 2, 'Weeks from start   0   4' from orders
 union all select l_orderkey, 2 + l_linenumber, concat(case l_partkey % 8 when 0 then 'Hematology' when 1 then 'Clinical chemistry' when 2 then 'Magnesium' when 3 then 'Lipids' when 4 then 'Insulin' when 5 then 'Urinalysis' when 6 then 'Zinc' else 'HIV testing' end,
   case when l_returnflag = 'R' then '  X' else '  -' end, case when l_linestatus = 'O' then '  X' else '   ' end, case when cast(l_quantity as int) % 2 = 0 then '  X' else '' end) from item
 union all select o_orderkey, 20, 'PK samples  X  X' from orders
 union all select o_orderkey, 30, case when o_orderkey % 3 = 0 then 'Appendix 2: Laboratory matters' else 'Clinical Laboratory Tests' end from orders
 union all select o_orderkey, 31, 'Hematology: assayed by sponsor-designated laboratory' from orders
 union all select o_orderkey, 32, 'Hemoglobin' from orders
 union all select o_orderkey, 33, 'Leukocytes (WBC), total' from orders
 union all select o_orderkey, 34, '- bullet' from orders
 union all select o_orderkey, 35, 'If abnormal then repeat' from orders
 union all select o_orderkey, 36, case when o_orderkey % 2 = 0 then 'Magnesium  assayed by sponsor designated laboratory' else 'Zinc assayed by sponsor-designated laboratory' end from orders
 union all select o_orderkey, 37, 'Lipids assayed by sponsor-designated laboratory' from orders
 union all select l_orderkey, 37 + l_linenumber, case l_partkey % 5 when 0 then 'Cholesterol If fasted' when 1 then 'Insulin' when 2 then 'The total' when 3 then '12 hours' else concat('Apo', chr(45), 'protein B, serum') end from item
 union all select o_orderkey, 50, case o_orderkey % 3 when 0 then 'Appendix 3: Other matters' when 1 then '10.3. Laboratory-free part' else '11. Next part' end from orders
 union all select o_orderkey, 51, 'Zirconium' from orders
 union all select o_orderkey, 52, 'Appendix 4' from orders
) t
"""

# --- aligned schedule and two-column appendix ---------------------------------------------------------

FIXTURES["aligned_line"] = """
select o_orderkey as doc_id, ln as line_no, txt as text from (
 select o_orderkey, 0 as ln, 'Author and Content Review' as txt from orders
 union all select o_orderkey, 1, 'Visit Number                  1      2      3' from orders
 union all select o_orderkey, 2, 'Weeks from Randomization      0      4      8' from orders
 union all select o_orderkey, 3, concat(rpad('Hematology', 30, ' '), 'X      ', case when o_orderkey % 2 = 0 then 'X' else ' ' end, '      X  fasted') from orders
 union all select l_orderkey, 3 + l_linenumber, concat(rpad(p_type, 30, ' '), case when l_returnflag = 'R' then 'X' else ' ' end, '      ', case when l_linestatus = 'O' then 'X' else ' ' end) from item join part on l_partkey = p_partkey
 union all select o_orderkey, 30, '  17  ' from orders
 union all select o_orderkey, 31, 'Visit Number                  1      2      3' from orders
 union all select o_orderkey, 32, concat(rpad('Hematology', 30, ' '), '       X') from orders
 union all select o_orderkey, 33, concat(rpad('Lipids', 30, ' '), 'X') from orders
 union all select o_orderkey, 40, '  Clinical Laboratory Tests       Comments' from orders
 union all select l_orderkey, 40 + l_linenumber, concat(p_name, case when l_returnflag = 'R' then '     local lab   only' else '' end) from item join part on l_partkey = p_partkey
 union all select o_orderkey, 60, 'CONFIDENTIAL' from orders
 union all select o_orderkey, 61, '10.3. Next part' from orders
 union all select o_orderkey, 62, 'After end' from orders
) t
"""

FIXTURES["appendix_line"] = """
select o_orderkey as doc_id, ln as line_no, txt as text from (
 select o_orderkey, 0 as ln, '# Appendix tests' as txt from orders
 union all select o_orderkey, 1, case when o_orderkey % 2 = 0 then 'These tests will be done at the central laboratory unless local testing is agreed.' else 'Short text.' end from orders
 union all select o_orderkey, 2, '| Clinical Laboratory Tests | Comments |' from orders
 union all select o_orderkey, 3, '|---|---|' from orders
 union all select l_orderkey, 3 + l_linenumber * 3, concat('| ', p_name, ' | ', l_shipmode, ' | note |') from li
 union all select l_orderkey, 4 + l_linenumber * 3, concat('Prose after the row about ', p_type, ' and ', p_name) from li where l_returnflag = 'R'
 union all select l_orderkey, 5 + l_linenumber * 3, case when l_linestatus = 'O' then 'Page 3 of 9' else 'more prose on handling of the material' end from li where l_returnflag = 'R'
) t
"""
FIXTURES["li"] = """
select l_orderkey, l_linenumber, p_name, p_type, l_returnflag, l_linestatus, case when l_tax > 0.04 then 'AIR' else '' end as l_shipmode from item join part on l_partkey = p_partkey
"""

# --- page tables ---------------------------------------------------------------------------------------

FIXTURES["page_cell"] = """
select o_orderkey as doc_id, table_name, table_ord, page, row_no, col_no, text from (
 select o_orderkey, case when o_orderkey % 2 = 0 then 'SoA' else ' soa ' end as table_name, 1 as table_ord, 1 as page, 0 as row_no, 0 as col_no, 'Test' as text from orders
 union all select o_orderkey, case when o_orderkey % 2 = 0 then 'SoA' else ' soa ' end, 1, 1, 0, 1, 'Visit 1' from orders
 union all select l_orderkey, case when l_orderkey % 2 = 0 then 'SoA' else ' soa ' end, 1, 1, l_linenumber, 0, case l_partkey % 6 when 0 then '' when 1 then 'Vital signs' when 2 then 'Register visit' when 3 then 'Blood pressure diary' else p_type end from item join part on l_partkey = p_partkey
 union all select l_orderkey, case when l_orderkey % 2 = 0 then 'SoA' else ' soa ' end, 1, 1, l_linenumber, 1, l_returnflag from item
 union all select l_orderkey, case when l_orderkey % 2 = 0 then 'SoA' else ' soa ' end, 1, 1, l_linenumber, 2, 'extra' from item where l_linestatus = 'O'
 union all select o_orderkey, 'SoA', 2, 2, 0, 0, 'Test' from orders
 union all select o_orderkey, 'SoA', 2, 2, 1, 0, 'Second page test' from orders
 union all select o_orderkey, 'SoA', 2, 2, 1, 1, o_orderstatus from orders
 union all select o_orderkey, 'SoA', 3, 3, 0, 0, null from orders where o_orderkey % 3 = 0
) t
"""

FIXTURES["bbox"] = """
select l_orderkey as doc_id, l_linenumber as page, l_quantity * 10 as x0, l_tax * 1000 as y0, l_quantity * 10 + 200 as x1, l_tax * 1000 + l_discount * 9000 as y1, 600.0 + l_linenumber as width, 800.0 as height from item
"""

FIXTURES["page_block"] = """
select c.conv_id as doc_id, c.turn as page, c.text, b.block_no, b.top, case when b.block_no is null then null else concat('<table><tr><td>', c.role, ' ', cast(b.block_no as string), '</td><td>a &amp; b</td></tr><tr><td>row two</td><td></td></tr></table>') end as html
from conversations c left join (select conv_id, turn, 0 as block_no, 500 - turn as top from conversations union all select conv_id, turn, 1, 100 + turn from conversations where role = 'user') b on c.conv_id = b.conv_id and c.turn = b.turn and c.turn % 3 <> 2
"""

FIXTURES["protocol_page"] = """
select conv_id as doc_id, turn as page, concat(case turn when 0 then concat('1.3. Schedule of Activities ........ 3', chr(10)) when 1 then case when conv_id % 2 = 0 then concat('1.3 Schedule of Activities', chr(10)) else concat('1.3. Schedule of Activities', chr(10), 'Added the text on panels', chr(10)) end
 when 2 then concat('1.3. Schedule of Activities', chr(10)) when 4 then case when conv_id % 3 = 0 then concat('x', chr(10), '  1.4. Next') else '2 none' end else '' end, text) as text
from conversations
"""

FIXTURES["html_table"] = """
select o_orderkey as doc_id, concat('<p>Intro &amp; more</p><table border="1"><tr><th>Name</th><th>Mark</th></tr>', chr(10), '<TR class="x"><td>', o_orderpriority, '</td><td> ', o_orderstatus, '  <b>x</b></td>', case when o_orderkey % 2 = 0 then '<td>a&lt;b &#39;q&#39;</td>' else '' end, '</TR>',
 case when o_orderkey % 3 = 0 then '<tr></tr><tr><td>last<br>line</td></tr>' else '' end, '</table><table><tr><th>only</th></tr></table>', case when o_orderkey % 5 = 0 then '<table><tr><td>p</td></tr><tr><td>q</td><td>r &eacute;</td></tr></table>' else '' end) as html
from orders
"""

# --- content in mixed formats ---------------------------------------------------------------------------

FIXTURES["content"] = """
select 'd' as kind, doc_id, 'markdown' as format, text as content from documents
union all select 'p', page_id, case when page_id % 2 = 0 then 'html' else 'auto' end, html from pages
union all select 'e', event_id, case when event_id % 2 = 0 then 'json' else 'auto' end, case when event_id % 5 = 0 then concat('{bad ', event_type) else concat('{"text": "', event_type, ' one", "k": {"note": "x', cast(event_id % 10 as string), '", "text": "', event_type, ' one"}}') end from events
"""

FIXTURES["json_doc"] = """
select event_id as doc_id, concat('{"zeta": "last ', event_type, '", "pages": [{"html": "<p>page ', cast(user_id as string), '</p>"}, "plain"], "text": "', event_type, '", "meta": {"note": "', event_type, '", "body": "inner ', cast(event_id % 9 as string), '"}, "n": 5}') as json
from events
"""

# --- candidates and catalog --------------------------------------------------------------------------------

FIXTURES["candidate"] = """
select l_orderkey as doc_id, concat('field', cast(l_linenumber % 4 as string)) as field, cast(l_partkey % 4 as int) as layer, l_linenumber as tier,
 case when l_returnflag = 'N' then '' when l_tax > 0.06 then null else concat('v', cast(l_suppkey as string)) end as value,
 case cast(l_partkey % 4 as int) when 0 then 'override' when 1 then 'structured' when 2 then 'label' else 'keyword' end as source
from item
"""

FIXTURES["override_src"] = """
select o_orderkey as doc_id, o_orderstatus as status, concat('p', cast(o_custkey as string)) as pval, case when o_orderkey % 3 = 0 then o_orderpriority else null end as flat from orders
"""

# --- forms ---------------------------------------------------------------------------------------------------

FIXTURES["form_cell"] = """
select o_orderkey as file_id, row_no, col_no, text from (
 select o_orderkey, 0 as row_no, 0 as col_no, case o_orderkey % 4 when 0 then 'Specimen Collection, Processing and Shipping' when 1 then 'Non-PK Data Mgmt Worksheet' else 'Form' end as text from orders
 union all select o_orderkey, 1, 0, case when o_orderkey % 4 in (0, 2) then concat('Analyte(s) for Measurement') else concat('Test name', chr(10), 'ignored') end from orders
 union all select o_orderkey, 1, 1, case when o_orderkey % 4 in (0, 2) then 'Analyte(s) for Measurement' else null end from orders
 union all select o_orderkey, 1, 2, case when o_orderkey % 4 in (0, 2) then null else 'x' end from orders
 union all select o_orderkey, 1, 3, concat('AN', cast(o_custkey as string)) from orders
 union all select o_orderkey, 2, 0, 'Assay Type' from orders
 union all select o_orderkey, 2, 1, case o_orderkey % 5 when 0 then 'ADA (Anti-drug antibody)' when 1 then ' ' else 'ELISA' end from orders
 union all select o_orderkey, 2, 2, 'Specimen Type' from orders
 union all select o_orderkey, 2, 3, case o_orderkey % 6 when 0 then 'DNA' when 1 then 'Serum' when 2 then 'Plasma' when 3 then 'RNA' else 'Hair' end from orders
 union all select o_orderkey, 3, 0, concat('Validation Complete', chr(10), case o_orderkey % 3 when 0 then 'true' when 1 then 'No' else 'pending' end, chr(10), 'Please note') from orders
 union all select o_orderkey, 4, 0, case when o_orderkey % 4 in (0, 2) then 'Bioanalytical Lab Name' else 'Reference Laboratory Name' end from orders where o_orderkey % 4 <> 3
 union all select o_orderkey, 4, 1, concat('Lab ', o_orderpriority) from orders where o_orderkey % 4 <> 3
 union all select o_orderkey, 5, 0, case when o_orderkey % 4 in (0, 2) then 'Type of tube' else 'Specimen Subtype' end from orders where o_orderkey % 3 <> 0
 union all select o_orderkey, 5, 1, 'EDTA' from orders where o_orderkey % 3 <> 0
 union all select o_orderkey, 6, 0, case when o_orderkey % 4 in (0, 2) then 'Tube size' else 'Address' end from orders
 union all select o_orderkey, 6, 1, concat(cast(o_orderkey % 10 as string), ' ml') from orders
 union all select o_orderkey, 7, 0, case when o_orderkey % 4 in (0, 2) then 'Long-term at -20 C (days)' else 'AMB' end from orders where o_orderkey % 2 = 0 or o_orderkey % 5 = 1
 union all select o_orderkey, 7, 1, cast(o_orderkey % 300 as string) from orders where o_orderkey % 2 = 0 or o_orderkey % 5 = 1
 union all select o_orderkey, 8, 0, 'REFR' from orders where o_orderkey % 4 in (1, 3)
 union all select o_orderkey, 8, 1, '14' from orders where o_orderkey % 4 in (1, 3)
 union all select o_orderkey, 9, 0, case when o_orderkey % 4 in (0, 2) then 'Contact Name' else 'Laboratory Contact' end from orders
 union all select o_orderkey, 9, 1, o_orderpriority from orders
) t
"""

FIXTURES["specimen_cell"] = """
select o_orderkey as file_id, role, row_no, col_no, text from (
 select o_orderkey, 'referral' as role, 0 as row_no, 0 as col_no, 'Attribute' as text from orders
 union all select o_orderkey, 'referral', 0, 1, 'LTS PK *' from orders
 union all select o_orderkey, 'referral', 0, 2, 'Limited use bmkr' from orders
 union all select o_orderkey, 'referral', 0, 3, concat('Limited  use', chr(10), 'bmkr') from orders
 union all select o_orderkey, 'referral', 0, 4, 'LTS Immunogenicity' from orders
 union all select o_orderkey, 'storage_wide', 0, 0, 'Attribute' from orders
 union all select o_orderkey, 'storage_wide', 0, 1, 'LTS DNA' from orders
 union all select o_orderkey, 'storage_wide', 0, 2, 'LTS Serum' from orders
 union all select o_orderkey, 'storage_wide', 0, 3, 'LTS Plasma' from orders
 union all select l_orderkey, 'referral', l_linenumber, 0, case l_linenumber when 1 then 'Analyte name' when 2 then 'Sample type' when 3 then 'Assay lab' else concat('Row ', cast(l_linenumber as string)) end from item
 union all select l_orderkey, 'referral', l_linenumber, 1, case l_partkey % 5 when 0 then 'NA' when 1 then 'List Assay Lab' when 2 then concat('val', cast(l_partkey as string)) when 3 then '7 (default)' else '' end from item
 union all select l_orderkey, 'referral', l_linenumber, 2, case when l_linenumber = 1 then 'Select' else '' end from item
 union all select l_orderkey, 'referral', l_linenumber, 3, case when l_returnflag = 'R' then 'frozen' else 'x ml or # FTA cards' end from item
 union all select l_orderkey, 'storage_wide', l_linenumber, 0, concat('Row ', cast(l_linenumber as string)) from item
 union all select l_orderkey, 'storage_wide', l_linenumber, 2, case when l_linestatus = 'O' then 'kept' else '#' end from item
) t
"""

FIXTURES["assignment"] = """
select l_orderkey as doc_id, l_linenumber as file_ord, concat('f', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as file_id,
 case l_partkey % 6 when 0 then 'referral:1' when 1 then 'referral:4' when 2 then 'storage_wide:2' when 3 then 'storage_wide:3' when 4 then 'storage_wide:1' else null end as column_key
from item
"""

FIXTURES["tissue"] = """
select o_orderkey as doc_id, concat('9.1. Tumor Tissue Samples', chr(10),
 case when o_orderkey % 2 = 0 then 'Archival tumor tissue may include surgical resection or core needle biopsies. ' else 'Plain text. ' end, chr(10),
 case when o_orderkey % 3 = 0 then 'FFPE samples are required for all. ' else '' end, chr(10),
 case when o_orderkey % 5 = 0 then 'Tissue blocks are preferred for shipment. ' else '' end, chr(10),
 case o_orderkey % 7 when 0 then concat('At least ', cast(o_orderkey % 20 + 1 as string), ' unstained slides are needed. ') when 1 then 'Send unstained slides cut at 4 to 5 microns. ' when 2 then 'The slides were cut 5 um. ' else '' end, chr(10),
 case when o_orderkey % 4 = 0 then 'Preferred tumor content is at least 20% overall. ' else '' end, chr(10),
 case when o_orderkey % 6 = 0 then 'Bone metastasis samples are not acceptable. ' else '' end, chr(10),
 case when o_orderkey % 8 = 0 then 'Cytology samples are acceptable. ' else '' end, chr(10),
 case when o_orderkey % 9 = 0 then 'Deidentified pathology reports are requested. More text follows here. ' else '' end, chr(10),
 case when o_orderkey % 10 = 0 then 'Confirmation of archival tumor tissue is due at screening. ' else '' end, chr(10),
 case when o_orderkey % 11 = 0 then 'An optional tumor tissue sample at progression. ' else '' end, chr(10),
 case when o_orderkey % 12 = 0 then 'Tissue samples will be retained for 15 years. ' else '' end, chr(10), '9.2. Other parts', chr(10), 'The end.') as text
from orders
"""

# Derived tables with many parts; they are written once and read back, as a line table would be.
STORED = ("protocol_line", "design_line", "question_line", "matrix_line", "visit_cell", "mapper_line", "aligned_line", "appendix_line", "page_cell", "form_cell", "specimen_cell")

_NAME = re.compile(r"\b(" + "|".join(FIXTURES) + r")\b")


def needed(names: tuple[str, ...]) -> list[str]:
    """The names with the derived tables they read, in dependency order."""
    out: list[str] = []
    for name in names:
        deps = [d for d in _NAME.findall(re.sub(r"'[^']*'", "", FIXTURES[name])) if d != name]
        for dep in [*needed(tuple(dict.fromkeys(deps))), name]:
            if dep not in out:
                out.append(dep)
    return out
