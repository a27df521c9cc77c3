"""DuckDB twins of the contract queries that SQL can express on whole tables.

Left out: license scans (patience alignment), suffix arrays (every byte place of the
corpus would be a row), language id, scoring, packing, secret scans and alignment (learned,
tokenized or compressed), periodic runs (every period of every text would be tried).  Tests compare those with brute force.
"""

from .quality import BOILERPLATE, END_MARKS, MAX_SYMBOLS, MIN_KEPT, NAVIGATION, SEPARATORS, SHORT_LINE

GAP = r"[\x20\x09-\x0D]"
_quote = lambda x: x.replace("'", "''")
_lower = lambda x: f"translate(coalesce({x},''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_words = lambda x: f"list_filter(regexp_split_to_array({x},'{GAP}+'), lambda x: x<>'')"
_chars = lambda x: f"length(regexp_replace({x},'{GAP}','','g'))"
_count = lambda x, cls: f"length(regexp_replace({x},'[^{cls}]','','g'))"

_good = f"""((contains('{_quote(END_MARKS)}',right(regexp_replace(l,'{GAP}+$',''),1)) or len({_words('l')})<={SHORT_LINE}) and {_count('l', '#*$%&|<>')}*100<={_chars('l')}*{MAX_SYMBOLS}
  and {_count('l', SEPARATORS)}<{NAVIGATION} and not ({' or '.join(f"contains(lower(l),'{b}')" for b in BOILERPLATE)}))"""

OP2 = f"""with recursive
d as (select doc_id,{_words(_lower('text'))} w from documents),
s as (select doc_id,list_distinct(case when len(w)=0 then [] when len(w)<4 then [w] else list_transform(range(1,len(w)-2), lambda i: w[i:i+3]) end) s from d),
x as (select doc_id,len(s) n,unnest(s) g from s),
c as (select a.doc_id u,b.doc_id v,a.n m,b.n n,count(*) c from x a join x b on a.g=b.g and a.doc_id<b.doc_id group by all),
e as (select u,v from c where 100*c>=80*(m+n-c)),
r as (select u a,v b from e union select v,u from e union select r.a,y.v from r join (select u,v from e union all select v,u from e) y on r.b=y.u),
k as (select a,min(b) m from r group by a)
select doc_id,len(s)::bigint n_shingles,least(doc_id,coalesce(m,doc_id)) component_id,doc_id<=coalesce(m,doc_id) kept from s left join k on a=doc_id"""

OP5 = f"""with d as (select row_number() over () r,doc_id,coalesce(text,'') t from documents),
w as (select *,{_words('t')} w,list_filter(string_split(t,chr(10)), lambda x: regexp_matches(x,'[^\\x20\\x09-\\x0D]')) ls from d),
win as (select r,i,w[i:i+7] g from (select r,w,unnest(range(1,len(w)-6)) i from w where len(w)>=8)),
rep as (select r,i from win qualify count(*) over (partition by r,g)>1),
cov as (select r,sum(least(8,coalesce(x-i,8))) n from (select r,i,lead(i) over (partition by r order by i) x from rep) group by r),
lines as (select r,sum({_chars('l')}) n from (select distinct r,unnest(ls) l from w) where {_good} group by r),
m as (select doc_id,len(w)::bigint n_words,{_chars('t')}::bigint word_chars,{_count('t', '#*$%&|<>')}::bigint n_symbols,(len(ls)-len(list_distinct(ls)))::bigint n_dup_lines,coalesce(cov.n,0)::bigint n_repeat_words,coalesce(lines.n,0) k from w left join cov using(r) left join lines using(r))
select doc_id,n_words,word_chars,n_symbols,n_dup_lines,n_repeat_words,(n_words<20 or 100*n_repeat_words>30*n_words) base_failed,not (n_words<20 or 100*n_repeat_words>30*n_words) and 100*k>={MIN_KEPT}*word_chars kept from m"""

OP6 = f"""with d as (select doc_id,{_words("coalesce(text,'')")} w from documents),
win as (select doc_id,i,w[i:i+12] g from (select doc_id,w,unnest(range(1,len(w)-11)) i from d where len(w)>=13)),
hit as (select doc_id,i from win qualify min(doc_id) over (partition by g)<doc_id),
gone as (select distinct doc_id,unnest(range(i,i+13)) i from hit),
word as (select doc_id,unnest(range(1,len(w)+1)) i,unnest(w) x from d where len(w)>0),
kept as (select doc_id,string_agg(x,' ' order by i) t,count(*) n from word anti join gone using(doc_id,i) group by doc_id)
select doc_id,len(w)::bigint n_words,(len(w)-coalesce(n,0))::bigint n_removed,sha256(coalesce(t,'')) kept_sha256 from d left join kept using(doc_id)"""

_tokens = lambda x: f"regexp_extract_all({_lower(x)},'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8 = f"""with b as (select item_id,{_tokens('text')} w from benchmark),
p as (select item_id,k,w[i:i+k-1] g from (select item_id,w,least(10,len(w)) k,unnest(range(1,len(w)-least(10,len(w))+2)) i from b where len(w)>0)),
q as (select distinct k from p),
d as (select doc_id,{_tokens('text')} w from documents),
win as (select doc_id,k,i,w[i:i+k-1] g from (select doc_id,w,k,unnest(range(1,len(w)-k+2)) i from d,q where len(w)>=k)),
hit as (select doc_id,i,k,item_id from win join p using(k,g)),
n as (select doc_id,count(*) n from (select distinct doc_id,unnest(range(i,i+k)) i from (select distinct doc_id,i,k from hit)) group by doc_id),
m as (select doc_id,count(*) n_items,string_agg(item,',' order by item) items from (select distinct doc_id,item_id::varchar item from hit) group by doc_id)
select doc_id,len(w)::bigint n_words,coalesce(n,0)::bigint n_hit,coalesce(n_items,0)::bigint n_items,sha256(coalesce(items,'')) items_sha256,coalesce(n,0)>0 contaminated from d left join n using(doc_id) left join m using(doc_id)"""

OP13 = f"""with d as (select row_number() over () r,doc_id,string_split(coalesce(text,''),chr(10)) ls from documents),
l as (select r,doc_id,unnest(range(1,len(ls)+1)) i,unnest(ls) x from d),
k as (select *,{_lower(f"regexp_replace(x,'^{GAP}+|{GAP}+$','','g')")} k from l),
g as (select k,max(doc_id) top from k where length(k)>=20 group by k having count(distinct r)>=3),
kept as (select r,string_agg(x,chr(10) order by i) t,count(*) n from k left join g using(k) where g.k is null or doc_id is not distinct from top group by r)
select doc_id,len(ls)::bigint n_lines,(len(ls)-coalesce(n,0))::bigint n_dropped,sha256(coalesce(t,'')) kept_sha256 from d left join kept using(r)"""

ORACLE: dict[str, str] = {"op2_minhash_near_dedup": OP2, "op5_quality_rules": OP5, "op6_substring_dedup": OP6, "op8_decontamination": OP8, "op13_line_dedup": OP13}
